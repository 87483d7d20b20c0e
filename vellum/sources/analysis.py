"""Analyses of document files: a summary a document, risks, and the corpus report over them."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.aggregate import content_density
from vellum.operators.classify import INCOMING_ROLES, incoming_roles, object_role, stream_role
from vellum.operators.inventory import PROGRAM_KEYS
from vellum.operators.sample import rankings
from vellum.sources import cos, documents, text_state

# Byte patterns whose raw overlapping counts are reported as risks.
RISKS = {
    "incremental-history": (("startxref",), "earlier revisions can keep what was removed later"),
    "info-dictionary": (("/Info",), "author, creator, producer and times"),
    "embedded-file": (("/EmbeddedFiles", "/EmbeddedFile"), "attached files that pages don't show"),
    "javascript": (("/JavaScript", "/JS"), "active hidden content"),
    "signature": (("/Sig",), "signer, certificates, times, reason and place"),
}


def risks(files: DataFrame) -> DataFrame:
    """(path, kind, count, note): raw pattern counts; one revision is no history; zero counts have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py() or b""
                for kind, (needles, note) in RISKS.items():
                    n = sum(_overlapping(data, x.encode()) for x in needles) - (kind == "incremental-history")
                    if n > 0:
                        rows.append((path, kind, n, note))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "kind", "count", "note"])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, count long, note string")


# Dictionary keys that are a risk wherever they stand, and what is said of each.
KEY_RISKS = {
    "thumbnail": (("Thumb",), "a page's small picture is hidden content of its own"),
    "automatic-action": (("AA", "OpenAction"), "actions that run by themselves"),
    "hidden-layer": (("OCProperties",), "layers can hide content from the default view"),
    "suspicious-hidden-text": (("ActualText",), "replacement text may differ from what is seen"),
    "piece-info": (("PieceInfo",), "private data of an authoring program"),
}


def object_risks(objects: DataFrame) -> DataFrame:
    """(doc_id, kind, count, note) of what dictionaries and streams hold; zero counts have no row."""
    has = lambda *names: F.arrays_overlap("keys", F.array(*[F.lit(n) for n in names]))
    both = F.array_contains("keys", "V") & F.array_contains("keys", "FT")
    jpeg = (F.col("subtype") == "Image") & F.array_contains("filters", "DCTDecode")
    rows = [F.struct(F.lit(k).alias("kind"), F.when(has(*names), 1).otherwise(0).alias("count"), F.lit(note).alias("note")) for k, (names, note) in KEY_RISKS.items()]
    rows.append(F.struct(F.lit("form-value").alias("kind"), F.when(both, 1).otherwise(0).alias("count"), F.lit("a field holds a value").alias("note")))
    rows.append(F.struct(F.lit("xmp-metadata").alias("kind"), F.when((F.col("type") == "stream") & (F.col("kind") == "Metadata"), 1).otherwise(0).alias("count"), F.lit("edit history, names, paths and tools").alias("note")))
    rows.append(F.struct(F.lit("jpeg-metadata").alias("kind"), F.when(jpeg, marker_count("raw")).otherwise(0).cast("int").alias("count"), F.lit("markers of metadata in JPEG data").alias("note")))
    found = objects.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*").where("count > 0")
    return found.groupBy("doc_id", "kind").agg(F.sum("count").alias("count"), F.min("note").alias("note"))


def marker_count(raw: str) -> F.Column:
    """How many bytes FF stand before E1, ED or FE."""
    return F.size(F.regexp_extract_all(F.decode(F.col(raw), "ISO-8859-1"), F.lit("(\u00ff)(?=[\u00e1\u00ed\u00fe])"), 0))


def risk_summary(files: DataFrame) -> DataFrame:
    """(path, kind, count, note): raw patterns and objects' risks of every file, zero counts left out."""
    paths = files.select("path", F.sha2("content", 256).alias("doc_id"))
    first = files.join(paths.groupBy("doc_id").agg(F.min("path").alias("path")).select("path"), "path", "left_semi")
    held = documents.scan_objects(first, ("doc_id", "type", "kind", "subtype", "keys", "filters", "raw"))
    return risks(files).union(object_risks(held).join(paths, "doc_id").select("path", "kind", "count", "note"))


def _overlapping(data: bytes, needle: bytes) -> int:
    n, at = 0, data.find(needle)
    while at >= 0:
        n, at = n + 1, data.find(needle, at + 1)
    return n


def roles(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects with `stream_role` and `role`, by how their documents' edges refer to them."""
    name = lambda c: F.concat_ws("#", "doc_id", F.col(c).cast("string"))
    links = edges.select(name("src").alias("src"), name("dst").alias("dst"), "key")
    pages = objects.where("kind = 'Page'").select(name("num").alias("node"))
    said = incoming_roles(links, pages)
    fonts = links.where(F.col("key").isin("FontFile", "FontFile2", "FontFile3")).select(F.col("dst").alias("node")).distinct().withColumn("is_font", F.lit(True))
    icc = links.where("key = 'ICCBased'").select(F.col("dst").alias("node")).distinct().withColumn("is_icc", F.lit(True))
    rows = objects.withColumn("node", name("num")).join(said, "node", "left").join(fonts, "node", "left").join(icc, "node", "left")
    rows = rows.withColumn("stream_role", F.when(F.col("type") == "stream", stream_role(F.col("kind"), F.col("subtype"), F.col("is_font"), F.col("is_icc"), F.coalesce("roles", F.array().cast("array<string>")), F.col("keys"))))
    return rows.withColumn("role", object_role(F.col("type"), F.col("kind"), F.col("subtype"), F.col("stream_role"))).drop("node", "roles", "is_font", "is_icc")


# --- the same in one pass over a document --------------------------------------------------------

#: Objects with what refers to them, by number: documents share no objects, so nothing of them need meet in a join.
NAMED = documents.OBJECTS + ", stream_role string, role string, reached boolean, incoming array<struct<src:long,key:string,path:array<string>>>"
ROLE_EDGES = documents.EDGES + ", source string, target string"
FONT_USES = "doc_id string, program long, num long, subtype string"


def _stream_role(kind: str | None, subtype: str | None, keys: dict, num: int, said: set[str], fonts: set[int], icc: set[int]) -> str:
    """`classify.stream_role` of one stream."""
    of_kind = {"Metadata": "metadata", "EmbeddedFile": "embedded-file", "ObjStm": "object-stream", "XRef": "xref-stream"}.get(kind)
    of_subtype = {"Image": "image", "Form": "form"}.get(subtype)
    if of_kind or of_subtype:
        return of_kind or of_subtype
    if num in fonts:
        return "font-program"
    if "page-content" in said:
        return "page-content"
    if num in icc:
        return "icc-profile"
    if said:
        return next(iter(said)) if len(said) == 1 else "multi-reference"
    if kind == "CMap":
        return "cmap"
    for key, role in (("PatternType", "pattern"), ("ShadingType", "shading"), ("FunctionType", "function")):
        if key in keys:
            return role
    return "image-like" if {"Width", "Height", "BitsPerComponent"} <= set(keys) else "other"


def _object_role(type_: str, kind: str | None, subtype: str | None, stream: str | None) -> str:
    """`classify.object_role` of one object."""
    if type_ == "stream":
        return f"stream:{stream}"
    if type_ != "dictionary":
        return type_
    if kind is not None:
        return f"dict:{kind}" if subtype is None else f"dict:{kind}/{subtype}"
    return "dict:untyped" if subtype is None else f"dict:subtype:{subtype}"


def _roles_of(doc: cos.Document, edges: list[tuple]) -> dict[cos.Ref, tuple[str | None, str]]:
    """(stream_role, role) of every object."""
    heads = {}
    for ref, value in doc.objects.items():
        own = documents.own_entries(value)
        heads[ref] = documents.own_name(doc, own, "Type"), documents.own_name(doc, own, "Subtype"), own
    pages = {ref.num for ref, (kind, _, _) in heads.items() if kind == "Page"}
    said, fonts, icc = defaultdict(set), set(), set()
    for _, src, key, _, dst in edges:
        if key in INCOMING_ROLES:
            said[dst].add(INCOMING_ROLES[key])
        elif key == "Contents" and src in pages:
            said[dst].add("page-content")
        elif key in PROGRAM_KEYS:
            fonts.add(dst)
        elif key == "ICCBased":
            icc.add(dst)
    out = {}
    for ref, value in doc.objects.items():
        kind, subtype, own = heads[ref]
        stream = _stream_role(kind, subtype, own, ref.num, said.get(ref.num, set()), fonts, icc) if isinstance(value, cos.Stream) else None
        out[ref] = stream, _object_role(documents.type_of(value), kind, subtype, stream)
    return out


def _reached(edges: list[tuple]) -> set[int]:
    """Numbers that the trailer reaches."""
    ahead_of = defaultdict(list)
    for _, src, _, _, dst in edges:
        ahead_of[src].append(dst)
    seen, ahead = set(), list(ahead_of[0])
    while ahead:
        num = ahead.pop()
        if num not in seen:
            seen.add(num)
            ahead += ahead_of.get(num, ())
    return seen


def scan_roles(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named ones of NAMED's columns: `roles` of objects in one pass, whether the trailer reaches them, and what refers to them."""
    wanted = tuple(columns)

    def each(doc: cos.Document) -> Iterator[tuple]:
        edges = list(documents._edges(doc))
        named = _roles_of(doc, edges) if {"stream_role", "role"} & set(wanted) else {}
        reached = _reached(edges) if "reached" in wanted else ()
        incoming = defaultdict(list)
        if "incoming" in wanted:
            for _, src, key, path, dst in edges:
                incoming[dst].append({"src": src, "key": key, "path": path})
        for ref, value in sorted(doc.objects.items()):
            row = documents.object_columns(doc, ref, value, wanted)
            row["stream_role"], row["role"] = named.get(ref, (None, None))
            row |= {"reached": ref.num in reached, "incoming": incoming.get(ref.num, [])}
            yield tuple(row[c] for c in wanted)

    return documents._scan(files, NAMED, each, wanted)


def role_edges(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named ones of ROLE_EDGES' columns: references with the roles of both ends; what isn't there is `missing`."""
    wanted = tuple(columns)
    place = [[part.split()[0] for part in ROLE_EDGES.split(", ")].index(c) for c in wanted]

    def each(doc: cos.Document) -> Iterator[tuple]:
        edges = list(documents._edges(doc))
        role = {ref.num: name for ref, (_, name) in _roles_of(doc, edges).items()}
        for edge in edges:
            whole = (*edge, role.get(edge[1], "missing" if edge[1] else "trailer"), role.get(edge[4], "missing"))
            yield tuple(whole[i] for i in place)

    return documents._scan(files, ROLE_EDGES, each, wanted)


def font_uses(files: DataFrame) -> DataFrame:
    """(doc_id, program, num, subtype): embedded programs and the fonts that use them through a descriptor."""

    def each(doc: cos.Document) -> Iterator[tuple]:
        programs, found = defaultdict(set), set()
        edges = list(documents._edges(doc))
        for _, src, key, _, dst in edges:
            if key in PROGRAM_KEYS:
                programs[src].add(dst)
        subtypes = defaultdict(set)
        for ref, value in doc.objects.items():
            subtypes[ref.num].add(documents.own_name(doc, documents.own_entries(value), "Subtype"))
        for _, src, key, _, dst in edges:
            if key == "FontDescriptor":
                found |= {(p, src, s) for p in programs.get(dst, ()) for s in subtypes.get(src, ())}
        for row in sorted(found, key=str):
            yield doc.sha256, *row

    return documents._scan(files, FONT_USES, each)


FORM_TWINS = "doc_id string, kind string, num long, canonical long"


def _same_forms(doc: cos.Document, edges: list[tuple], ignored: Sequence[str]) -> Iterator[tuple[int, int]]:
    """(num, canonical) of a document's forms that equal a lesser one, as `inventory.form_twins` finds them."""
    ahead_of = defaultdict(list)
    for _, src, _, path, dst in edges:
        slot = "/".join(path)
        if not slot.startswith("Parent"):
            ahead_of[src].append((slot, dst))
    below, ahead, forms = set(), [], []
    for ref, value in doc.objects.items():
        if documents.own_name(doc, documents.own_entries(value), "Subtype") == "Form":
            forms.append(ref)
            ahead.append(ref.num)
    while ahead:
        num = ahead.pop()
        if num not in below:
            below.add(num)
            ahead += [dst for _, dst in ahead_of.get(num, ())]
    classes: dict[cos.Ref, object] = {}
    for ref, value in doc.objects.items():
        if ref.num in below:
            own = documents.object_columns(doc, ref, value, ("type", "value", "raw"))
            held = json.loads(own["value"])
            entries = [(k, json.dumps(v)) for k, v in sorted(held.items()) if k not in (*ignored, "Length") and not (isinstance(v, str) and _REFERENCE.match(v))] if isinstance(held, dict) else []
            classes[ref] = own["type"], own["raw"] or b"", tuple(entries), None if own["type"] == "stream" else _REFERENCES.sub("ref", own["value"])
    count = 0
    while True:
        number: dict[object, int] = {}
        classes = {ref: number.setdefault(c, len(number)) for ref, c in classes.items()}
        if len(number) == count:
            break
        count, of = len(number), defaultdict(list)
        for ref, c in classes.items():
            of[ref.num].append(c)
        classes = {ref: (c, tuple(sorted((slot, to) for slot, dst in ahead_of.get(ref.num, ()) for to in of.get(dst, (-1,))))) for ref, c in classes.items()}
    least: dict[object, int] = {}
    for ref in forms:
        least[classes[ref]] = min(ref.num, least.get(classes[ref], ref.num))
    for ref in sorted(forms):
        if least[classes[ref]] != ref.num:
            yield ref.num, least[classes[ref]]


_REFERENCE, _REFERENCES = re.compile(r"\d+ \d+ R$"), re.compile(r"\d+ \d+ R")


def form_twins(files: DataFrame, kinds: dict[str, Sequence[str]]) -> DataFrame:
    """(doc_id, kind, num, canonical): `inventory.form_twins` in one pass, for each kind that names what it ignores."""

    def each(doc: cos.Document) -> Iterator[tuple]:
        edges = list(documents._edges(doc))
        for kind, ignored in kinds.items():
            for num, canonical in _same_forms(doc, edges, ignored):
                yield doc.sha256, kind, num, canonical

    return documents._scan(files, FORM_TWINS, each)


def summaries(files: DataFrame) -> DataFrame:
    """One row a readable document: sizes, counts, wasted bytes by role and hidden texts.

    Files with equal contents are scanned once, under the first of their paths, and each has its row.
    """
    paths = files.select("path", F.sha2("content", 256).alias("doc_id"), F.octet_length("content").cast("long").alias("input_bytes"))
    files = files.join(paths.groupBy("doc_id").agg(F.min("path").alias("path")).select("path"), "path", "left_semi")
    objects, edges, pages = documents.scan_objects(files), documents.scan_edges(files), documents.scan_pages(files)
    named = roles(objects, edges)
    size = F.when(F.col("type") == "stream", F.col("raw_len")).otherwise(0)
    of = lambda r: F.sum(F.when(F.col("stream_role") == r, F.col("raw_len")).otherwise(0)).cast("long")
    base = named.groupBy("doc_id").agg(F.count("*").alias("objects"), F.count_if(F.col("type") == "stream").alias("streams"), F.sum(size).cast("long").alias("stream_bytes"), of("image").alias("image_bytes"), of("font-program").alias("font_program_bytes"), of("metadata").alias("metadata_stream_bytes"))
    copies = named.where("raw IS NOT NULL").groupBy("doc_id", F.sha2("raw", 256).alias("d")).agg(F.count("*").alias("n"), F.min("raw_len").alias("size"), F.min("stream_role").alias("role")).where("n > 1")
    waste = F.col("size") * (F.col("n") - 1)
    wasted = copies.groupBy("doc_id").agg(F.sum(waste).alias("duplicate_stream_wasted_bytes"), *(F.sum(F.when(F.col("role") == r, waste).otherwise(0)).alias(f"duplicate_{r}_wasted_bytes") for r in ("image", "form", "metadata")))
    paged = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    density = content_density(documents.parse_content(pages))
    hidden = text_state.scan_hidden(files).groupBy("doc_id").agg(F.count("*").alias("hidden_text_findings"))
    out = paths.join(base, "doc_id")
    for part in (wasted, paged, density, hidden):
        out = out.join(part, "doc_id", "left")
    return out.fillna(0)


METRICS = ("input_bytes", "duplicate_stream_wasted_bytes", "duplicate_image_wasted_bytes", "duplicate_form_wasted_bytes", "duplicate_metadata_wasted_bytes", "metadata_stream_bytes", "font_program_bytes", "hidden_text_findings")


def corpus_rankings(rows: DataFrame, k: int = 20) -> DataFrame:
    """The k highest documents of each metric, zeros left out, ties by path."""
    return rankings(rows, list(METRICS), ["path"], k)
