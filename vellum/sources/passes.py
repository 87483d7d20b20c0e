"""Passes that rewrite document files: preservation, privacy scrub, normalised contents, hidden text taken out.

A pass maps files to files, one document a row, and counts what it took. Every pass is a list of steps
over a parsed document's objects; what can't be read keeps its bytes and has its error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.codecs import flate, strip_jpeg_metadata
from vellum.operators.display import normal_form, remove_ranges
from vellum.operators.policy import CATALOG_KEYS, DANGEROUS_ACTIONS, LINK_SHELL_KEYS, PAGE_KEYS, PAGE_TREE_KEYS, PRESETS
from vellum.sources import cos
from vellum.sources.documents import UNREADABLE

OUT = "path string, doc_id string, content binary, counts map<string,long>, error string"
#: Annotation flags: hidden and no view; a reader asks for its own appearances.
HIDDEN_FLAGS = 0x02 | 0x20
Step = Callable[[cos.Document, Counter], None]


def _over(steps: Callable[[pa.RecordBatch, int], Sequence[Step]], packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
                counts, doc_id, out, error = Counter(), None, data, None
                try:
                    doc = cos.parse(data)
                    doc_id = doc.sha256
                    for step in steps(batch, i):
                        step(doc, counts)
                    out = cos.write(doc, packed)
                except UNREADABLE as problem:
                    counts, error = Counter(), f"{type(problem).__name__}: {problem}"
                kept = [(k, v) for k, v in sorted(counts.items()) if v]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([doc_id], pa.string()), pa.array([out], pa.binary()), pa.array([kept], pa.map_(pa.string(), pa.int64())), pa.array([error], pa.string())], ["path", "doc_id", "content", "counts", "error"])

    return run


def apply(files: DataFrame, steps: Sequence[Step], packed: bool = True) -> DataFrame:
    """(path, doc_id, content, counts, error) of files after the steps."""
    return files.select("path", "content").mapInArrow(_over(lambda batch, i: steps, packed), OUT)


# --- dictionaries --------------------------------------------------------------------------------


def _holders(doc: cos.Document) -> Iterator[dict]:
    """Every dictionary of the document, nested ones too."""
    ahead: list = list(doc.objects.values())
    while ahead:
        value = ahead.pop()
        if isinstance(value, cos.Stream):
            value = value.dict
        if isinstance(value, dict):
            yield value
            ahead += value.values()
        elif isinstance(value, list):
            ahead += value


def _drop(holder: dict, keys: Sequence[str], counts: Counter, label: str | Callable[[str], str]) -> None:
    for key in [k for k in holder if k in keys]:
        del holder[key]
        counts[label if isinstance(label, str) else label(key)] += 1


def drop_everywhere(keys: Sequence[str], label: str) -> Step:
    """Keys that go from every dictionary."""

    def step(doc: cos.Document, counts: Counter) -> None:
        for holder in _holders(doc):
            _drop(holder, keys, counts, label)

    return step


def allow_keys(pick: Callable[[cos.Document], Iterator[dict]], table: dict, on: frozenset[str], label: str) -> Step:
    """Holders keep what the table allows under the switches that are on."""
    switch = {k: s for s, keys in table.items() for k in keys}

    def kept(key: str) -> bool:
        s = switch.get(key, "unknown_objects")
        return s is None or s in on

    def step(doc: cos.Document, counts: Counter) -> None:
        for holder in pick(doc):
            _drop(holder, [k for k in holder if not kept(k)], counts, label)

    return step


def _own_pages(doc: cos.Document) -> Iterator[dict]:
    for ref, _ in doc.pages():
        if ref is not None:
            yield doc.objects[ref]


def _tree_nodes(doc: cos.Document) -> Iterator[dict]:
    for value in doc.objects.values():
        if isinstance(value, dict) and doc.get(value.get("Type")) == "Pages":
            yield value


def _catalog(doc: cos.Document) -> Iterator[dict]:
    found = doc.get(doc.trailer.get("Root"))
    if isinstance(found, dict):
        yield found


# --- annotations ---------------------------------------------------------------------------------


def _annotations(doc: cos.Document, page: dict) -> list:
    found = doc.get(page.get("Annots"))
    return list(found) if isinstance(found, list) else []


def filter_annotations(on: frozenset[str], others: bool) -> Step:
    """Links and widgets stay under their switches, other annotations with `others`."""
    protected = {"Link": "links" in on, "Widget": "forms" in on}

    def step(doc: cos.Document, counts: Counter) -> None:
        for page in _own_pages(doc):
            found = _annotations(doc, page)
            kept = [a for a in found if protected.get(str(doc.get(doc.dictionary(a).get("Subtype"))), others)]
            counts["annotations"] += len(found) - len(kept)
            if len(kept) < len(found):
                page["Annots"] = kept
                if not kept:
                    del page["Annots"]

    return step


def link_shells(doc: cos.Document, counts: Counter) -> None:
    """Links keep what they show, not where they lead."""
    for page in _own_pages(doc):
        for found in _annotations(doc, page):
            own = doc.dictionary(found)
            if doc.get(own.get("Subtype")) == "Link":
                _drop(own, [k for k in own if k not in (*LINK_SHELL_KEYS, "Type", "Subtype")], counts, "link-keys")


def flatten_annotations(required: int = 0, forbidden: int = HIDDEN_FLAGS) -> Step:
    """Annotations' normal appearances become forms that the page draws; hidden ones are left out.

    With the annotations goes the form dictionary, unless it asks readers for appearances of their own.
    """

    def appearance(doc: cos.Document, own: dict) -> cos.Ref | None:
        normal = doc.dictionary(own.get("AP")).get("N")
        if isinstance(doc.get(normal), dict):
            state = doc.get(own.get("AS"))
            normal = doc.get(normal).get(str(state)) if isinstance(state, cos.Name) else None
        return normal if isinstance(normal, cos.Ref) and isinstance(doc.get(normal), cos.Stream) else None

    def numbers(doc: cos.Document, value, n: int) -> list[float] | None:
        found = [doc.get(v) for v in doc.get(value) or []] if isinstance(doc.get(value), list) else []
        return [float(v) for v in found] if len(found) == n and all(isinstance(v, (int, float)) for v in found) else None

    def step(doc: cos.Document, counts: Counter) -> None:
        form = doc.dictionary(doc.dictionary(doc.trailer.get("Root")).get("AcroForm"))
        keep_fields = doc.get(form.get("NeedAppearances")) is True
        for page in _own_pages(doc):
            drawn, kept = [], []
            for found in _annotations(doc, page):
                own = doc.dictionary(found)
                flags = doc.get(own.get("F", 0))
                flags = flags if isinstance(flags, int) else 0
                if keep_fields and doc.get(own.get("Subtype")) == "Widget":
                    kept.append(found)
                    continue
                if flags & forbidden or flags & required != required:
                    continue
                stream, rect = appearance(doc, own), numbers(doc, own.get("Rect"), 4)
                box = numbers(doc, doc.get(stream).dict.get("BBox"), 4) if stream else None
                if not (stream and rect and box) or box[0] == box[2] or box[1] == box[3]:
                    continue
                x0, y0, x1, y1 = min(rect[0], rect[2]), min(rect[1], rect[3]), max(rect[0], rect[2]), max(rect[1], rect[3])
                sx, sy = (x1 - x0) / abs(box[2] - box[0]), (y1 - y0) / abs(box[3] - box[1])
                drawn.append((stream, [sx, 0.0, 0.0, sy, x0 - min(box[0], box[2]) * sx, y0 - min(box[1], box[3]) * sy]))
            counts["flattened"] += len(drawn)
            page.pop("Annots", None)
            if kept:
                page["Annots"] = kept
            if not drawn:
                continue
            inherited = next(p for r, p in doc.pages() if r is not None and doc.objects[r] is page)
            resources = dict(doc.dictionary(inherited.get("Resources")))
            named, body = dict(doc.dictionary(resources.get("XObject"))), b"Q\n"
            for stream, matrix in drawn:
                doc.get(stream).dict |= {"Type": cos.Name("XObject"), "Subtype": cos.Name("Form")}
                name = next(f"Fl{k}" for k in range(len(named) + 1) if f"Fl{k}" not in named)
                named[name] = stream
                body += b"q " + b" ".join(map(cos.serialise, matrix)) + b" cm /" + name.encode() + b" Do Q\n"
            page["Resources"] = resources | {"XObject": named}
            _replace_content(doc, page, b"q\n" + doc.content(page) + b"\n" + body)
        if not keep_fields:
            for holder in _catalog(doc):
                _drop(holder, ["AcroForm"], counts, "form-dictionary")

    return step


# --- contents ------------------------------------------------------------------------------------


def _replace_content(doc: cos.Document, page: dict, content: bytes) -> None:
    ref = cos.Ref(max((r.num for r in doc.objects), default=0) + 1)
    doc.objects[ref] = cos.Stream({"Filter": cos.Name("FlateDecode")}, flate(content))
    page["Contents"] = ref


def normalise_contents(doc: cos.Document, counts: Counter) -> None:
    """Every page's content with one instruction a line, where that is safe."""
    for page in _own_pages(doc):
        old = doc.content(page)
        new = normal_form(old)
        if new != old:
            counts["normalised-pages"] += 1
            _replace_content(doc, page, new)


def preserve(files: DataFrame, preset: str = "functional", others: bool | None = None, flatten: bool = False, normalise: bool = False, packed: bool = True) -> DataFrame:
    """Files that keep what a preset asks for: annotations, private data, metadata, page, tree and catalogue keys.

    `others` says whether annotations that are neither links nor widgets stay (as unknown objects do,
    by default). With `flatten` annotations become page content, with `normalise` contents their normal form.
    """
    on = PRESETS[preset]
    steps: list[Step] = [flatten_annotations()] if flatten else []
    steps.append(filter_annotations(on, "unknown_objects" in on if others is None else others))
    if "private_authoring_data" not in on:
        steps.append(drop_everywhere(["PieceInfo"], "private-data"))
    if "metadata" not in on:
        steps += [drop_everywhere(["Metadata", "LastModified"], "metadata"), lambda doc, counts: _drop(doc.trailer, ["Info"], counts, "metadata")]
    steps.append(drop_everywhere(["Thumb"], "thumbnails"))
    steps += [allow_keys(_own_pages, PAGE_KEYS, on, "page-keys"), allow_keys(_tree_nodes, PAGE_TREE_KEYS, on, "tree-keys"), allow_keys(_catalog, CATALOG_KEYS, on, "catalog-keys")]
    if normalise:
        steps.append(normalise_contents)
    return apply(files, steps, packed)


# --- privacy -------------------------------------------------------------------------------------


def dangerous(doc: cos.Document, action) -> bool:
    """Whether an action, or one that follows it, is of a dangerous kind; circles end."""
    ahead, seen = [action], set()
    while ahead:
        value = ahead.pop()
        if isinstance(value, cos.Ref):
            if value in seen:
                continue
            seen.add(value)
        found = doc.get(value)
        if isinstance(found, list):
            ahead += found
        elif isinstance(found, dict):
            if doc.get(found.get("S")) in DANGEROUS_ACTIONS:
                return True
            if "Next" in found:
                ahead.append(found["Next"])
    return False


def _active_content(doc: cos.Document, counts: Counter) -> None:
    for holder in _holders(doc):
        _drop(holder, ["AA"], counts, "additional-actions")
        for key in ("A", "OpenAction"):
            if key in holder and dangerous(doc, holder[key]):
                _drop(holder, [key], counts, "dangerous-actions")
    for holder in _catalog(doc):
        _drop(doc.dictionary(holder.get("Names")), ["JavaScript"], counts, "javascript-names")


def _attachments(doc: cos.Document, counts: Counter) -> None:
    for holder in _catalog(doc):
        _drop(doc.dictionary(holder.get("Names")), ["EmbeddedFiles"], counts, "attachments")
    for holder in _holders(doc):
        _drop(holder, ["AF"], counts, "attachments")
    for page in _own_pages(doc):
        found = _annotations(doc, page)
        kept = [a for a in found if doc.get(doc.dictionary(a).get("Subtype")) != "FileAttachment"]
        counts["attachments"] += len(found) - len(kept)
        if len(kept) < len(found):
            page["Annots"] = kept


def _signatures(doc: cos.Document, counts: Counter) -> None:
    gone = 0
    for holder in _holders(doc):
        if doc.get(holder.get("FT")) == "Sig" and "V" in holder:
            del holder["V"]
            gone += 1
    for holder in _catalog(doc):
        gone += "Perms" in holder
        holder.pop("Perms", None)
        doc.dictionary(holder.get("AcroForm")).pop("SigFlags", None)
    counts["signature-values"] += bool(gone)


def _field_values(doc: cos.Document, counts: Counter) -> None:
    for holder in _holders(doc):
        if "FT" in holder or doc.get(holder.get("Subtype")) == "Widget":
            _drop(holder, ["V", "DV", "RV"], counts, "form-value")


def _jpegs(aggressive: bool) -> Step:
    def step(doc: cos.Document, counts: Counter) -> None:
        for value in doc.objects.values():
            if isinstance(value, cos.Stream) and doc.filters(value)[0] == ["DCTDecode"]:
                found = strip_jpeg_metadata(value.raw, aggressive)
                if found and found[1]:
                    value.raw = found[0]
                    counts["jpeg-metadata"] += 1

    return step


def scrub_files(files: DataFrame, level: int, on: Sequence[str] = ("active_content", "attachments", "signatures", "form_values"), jpegs: bool = True, aggressive: bool = False, packed: bool = True) -> DataFrame:
    """Files without private data: level 0 changes nothing, 1 takes metadata, 2 also what the switches name."""
    steps: list[Step] = []
    if level >= 1:
        for key, label in (("Info", "info-dictionary"), ("ID", "document-id")):
            steps.append(lambda doc, counts, key=key, label=label: _drop(doc.trailer, [key], counts, label))
        steps += [drop_everywhere([k], label) for k, label in (("Metadata", "xmp-reference"), ("PieceInfo", "piece-info"), ("LastModified", "last-modified"))]
    if level >= 2:
        steps.append(drop_everywhere(["Thumb"], "thumbnail"))
        steps += [step for name, step in (("active_content", _active_content), ("attachments", _attachments), ("signatures", _signatures), ("form_values", _field_values)) if name in on]
    if level >= 1 and jpegs:
        steps.append(_jpegs(aggressive))
    return apply(files, steps, packed)


# --- hidden text ---------------------------------------------------------------------------------


def remove_hidden(files: DataFrame, findings: DataFrame, packed: bool = True) -> DataFrame:
    """Files without the texts of `findings` (doc_id, page, depth, start, end, remove) that are to go.

    Only texts that a page shows itself go; those inside forms stay, as another page may show them.
    """
    spots = F.struct(F.col("page").cast("int").alias("page"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    gone = findings.where("remove AND depth = 0 AND start IS NOT NULL").groupBy("doc_id").agg(F.collect_list(spots).alias("spots"))
    rows = files.select("path", "content", F.sha2("content", 256).alias("doc_id")).join(gone, "doc_id", "left").select("path", "content", "spots")

    def steps(batch: pa.RecordBatch, i: int) -> list[Step]:
        spots = batch.column(2)[i].as_py() or []

        def step(doc: cos.Document, counts: Counter) -> None:
            for k, (ref, page) in enumerate(doc.pages()):
                own = [(x["start"], x["end"]) for x in spots if x["page"] == k]
                if own and ref is not None:
                    counts["hidden-texts"] += len(own)
                    _replace_content(doc, doc.objects[ref], remove_ranges(doc.content(page), own))

        return [step]

    return rows.mapInArrow(_over(steps, packed), OUT)
