"""Inventories over object graphs: edge and key counts, owners, font programs, exact twins by target, gates and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.dedup import fingerprint, fixed_point_canonical
from vellum.operators.graph import reachable
from vellum.session import checkpoint

#: Keys of a stream that keeps its data in another file.
EXTERNAL_KEYS = ("F", "FFilter", "FDecodeParms")
PROGRAM_KEYS = ("FontFile", "FontFile2", "FontFile3")


def _node(column: str) -> Column:
    return F.concat_ws("#", "doc_id", F.col(column).cast("string"))


def edge_counts(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, key, target, edges): references between roles; a target that isn't there is `missing`.

    `objects` are (doc_id, num, role).
    """
    of = lambda end, name: objects.select("doc_id", F.col("num").alias(end), F.col("role").alias(name))
    rows = edges.join(of("src", "source"), ["doc_id", "src"], "left").join(of("dst", "target"), ["doc_id", "dst"], "left")
    rows = rows.select(F.coalesce("source", F.when(F.col("src") == 0, "trailer").otherwise("missing")).alias("source"), "key", F.coalesce("target", F.lit("missing")).alias("target"))
    return rows.groupBy("source", "key", "target").agg(F.count("*").alias("edges"))


def key_counts(objects: DataFrame) -> DataFrame:
    """(role, key, objects): how many objects of a role have a key."""
    return objects.select("role", F.explode("keys").alias("key")).groupBy("role", "key").agg(F.count("*").alias("objects"))


def streams_with_subtype(objects: DataFrame, edges: DataFrame, subtype: str) -> DataFrame:
    """Streams of a subtype that the trailer reaches."""
    links = edges.select(_node("src").alias("src"), _node("dst").alias("dst"))
    roots = links.where(F.col("src").endswith("#0")).select(F.col("dst").alias("node"))
    found = objects.where((F.col("type") == "stream") & (F.col("subtype") == subtype)).withColumn("node", _node("num"))
    return found.join(reachable(links, roots), "node", "left_semi").drop("node")


def incoming_owners(edges: DataFrame) -> DataFrame:
    """(doc_id, num, owners, references): the distinct objects that refer to an object."""
    return edges.groupBy("doc_id", F.col("dst").alias("num")).agg(F.array_sort(F.collect_set("src")).alias("owners"), F.count("*").alias("references"))


def font_programs(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, program, users, only_cid_truetype): the fonts that use each embedded program, through their descriptors."""
    programs = edges.where(F.col("key").isin(*PROGRAM_KEYS)).select("doc_id", F.col("src").alias("descriptor"), F.col("dst").alias("program"))
    holders = edges.where("key = 'FontDescriptor'").select("doc_id", F.col("dst").alias("descriptor"), F.col("src").alias("num"))
    fonts = objects.select("doc_id", "num", "subtype")
    return programs_of(programs.join(holders, ["doc_id", "descriptor"]).join(fonts, ["doc_id", "num"]))


def programs_of(uses: DataFrame) -> DataFrame:
    """The same of uses (doc_id, program, num, subtype), as `analysis.font_uses` finds them in one pass."""
    used = uses.select("doc_id", "program", "num", "subtype").distinct()
    return used.groupBy("doc_id", "program").agg(F.array_sort(F.collect_set("num")).alias("users"), F.bool_and(F.coalesce(F.col("subtype") == "CIDFontType2", F.lit(False))).alias("only_cid_truetype"))


def glyph_unions(usage: DataFrame, group: Sequence[str], codes: str = "codes") -> DataFrame:
    """(group, codes): all codes that any program of a group shows, in order."""
    return usage.select(*group, F.explode(codes).alias("code")).distinct().groupBy(*group).agg(F.array_sort(F.collect_list("code")).alias("codes"))


def is_plain_stream(keys: Column, filters: Column) -> Column:
    """Whether a stream keeps its own data, as they are or under a single Flate filter."""
    outside = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in EXTERNAL_KEYS]))
    count = F.coalesce(F.size(filters), F.lit(0))
    return ~F.coalesce(outside, F.lit(False)) & ((count <= 0) | ((count == 1) & filters[0].isin("FlateDecode", "Fl")))


def matching_inputs(files: DataFrame, known: DataFrame) -> DataFrame:
    """`known` analyses (size, sha256, …) of files (path, content) that have not changed since."""
    now = files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    return now.join(known, ["size", "sha256"])


def cache_hits(streams: DataFrame, cache: DataFrame, on: Sequence[str] = ("num", "level", "digest")) -> DataFrame:
    """Streams whose compressed form is known, with it; of several the first."""
    w = Window.partitionBy(*on).orderBy("encoded")
    first = cache.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return streams.join(first, list(on))


def retargets(stale: DataFrame, live: DataFrame, on: str = "fingerprint") -> DataFrame:
    """(old, new): pages that stand for others of an equal fingerprint, where that leaves no choice."""
    one = live.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n"), F.min("page").alias("new")).where("n = 1")
    return stale.join(one, on).select(F.col("page").alias("old"), "new")


# --- exact twins by target -----------------------------------------------------------------------

#: What a target's objects are, and the keys that don't tell them apart.
TARGETS = ("metadata", "font-program", "to-unicode", "icc-profile", "type3-charproc", "image", "appearance", "page-content", "sampled-function", "ext-gstate", "structure-attributes", "font")


def dedup_targets(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, num, target): objects that may stand for one another, and as what; forms are apart.

    `objects` come from `analysis.roles` with stream_role, `edges` name the keys that refer to them.
    """
    under = edges.select("doc_id", F.col("dst").alias("num"), F.col("key_path").alias("path"), "key")
    has = lambda name: F.array_contains("path", name)
    said = under.groupBy("doc_id", "num").agg(F.max(has("AP")).alias("appearance"), F.max(has("ExtGState")).alias("gstate"), F.max(has("CharProcs")).alias("charproc"), F.max(F.col("key") == "A").alias("attributes"))
    rows = objects.join(said, ["doc_id", "num"], "left")
    target = _target(*(F.coalesce(c, F.lit(False)) for c in ("appearance", "gstate", "charproc", "attributes")))
    return rows.withColumn("target", target).where("target IS NOT NULL").select("doc_id", "num", "target")


def with_targets(objects: DataFrame) -> DataFrame:
    """Objects of `analysis.scan_roles` with `incoming` that may stand for one another, and their `target`."""
    has = lambda name: F.exists("incoming", lambda x: F.array_contains(x["path"], name))
    target = _target(has("AP"), has("ExtGState"), has("CharProcs"), F.exists("incoming", lambda x: x["key"] == "A"))
    return objects.withColumn("target", target).where("target IS NOT NULL")


def _target(appearance: Column, gstate: Column, charproc: Column, attributes: Column) -> Column:
    stream, dictionary, role = F.col("type") == "stream", F.col("type") == "dictionary", F.col("stream_role")
    return (
        F.when(stream & appearance, "appearance")
        .when(stream & charproc, "type3-charproc")
        .when(stream & role.isin("metadata", "font-program", "to-unicode", "icc-profile", "image", "page-content"), role)
        .when(stream & F.array_contains("keys", "FunctionType") & (F.get_json_object("value", "$.FunctionType") == "0"), "sampled-function")
        .when(dictionary & ((F.col("kind") == "ExtGState") | gstate), "ext-gstate")
        .when(dictionary & attributes & F.array_contains("keys", "O"), "structure-attributes")
        .when(dictionary & (F.col("kind") == "Font"), "font")
    )


def exact_twins(objects: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, target, num, canonical): the least object of a target with the same bytes and entries, for all others."""
    return twins_of(objects.join(targets, ["doc_id", "num"]))


def twins_of(rows: DataFrame) -> DataFrame:
    """The same of objects that have their `target`."""
    rows = rows.withColumn("entries", F.from_json("value", "map<string,string>"))
    rows = rows.withColumn("fp", fingerprint(F.coalesce("raw", F.lit("").cast("binary")), F.col("entries")))
    w = Window.partitionBy("doc_id", "target", "fp")
    return rows.withColumns({"canonical": F.min("num").over(w)}).where("num <> canonical").select("doc_id", "target", "num", "canonical")


def has_twins(objects: DataFrame, targets: DataFrame, target: str) -> bool:
    """Whether any two objects of a target are equal: a probe before a rewrite is planned."""
    return not exact_twins(objects, targets.where(F.col("target") == target)).isEmpty()


def form_twins(objects: DataFrame, edges: DataFrame, ignored: Sequence[str] = ("Length",)) -> DataFrame:
    """(doc_id, num, canonical): forms that are equal with all they refer to, to the fixed point.

    With `ignored` naming LastModified too, forms that differ in their dates alone are equal.
    """
    graph = edges.select(_node("src").alias("src"), F.array_join("key_path", "/").alias("slot"), _node("dst").alias("dst"))
    entries = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin(*ignored) & ~F.coalesce(v.rlike(r"^\d+ \d+ R$"), F.lit(False)))
    body = F.concat_ws("|", "type", fingerprint(F.coalesce("raw", F.lit("").cast("binary")), entries), F.when(F.col("type") != "stream", F.regexp_replace("value", r"\d+ \d+ R", "ref")))
    nodes, graph = objects.withColumn("key", _node("num")), graph.where(~F.col("slot").startswith("Parent"))
    below = reachable(graph, nodes.where("subtype = 'Form'"), node="key")  # nothing else can tell forms apart
    same = fixed_point_canonical(nodes.select("key", body.alias("body")).join(below.withColumnRenamed("node", "key"), "key", "left_semi"), graph.join(below.withColumnRenamed("node", "src"), "src", "left_semi"))
    # documents don't share objects: of a class the least form of the same document stands for it
    forms = nodes.where("subtype = 'Form'").select("doc_id", "num", "key").join(same, "key")
    w = Window.partitionBy("doc_id", "canonical")
    return forms.withColumn("least", F.min("num").over(w)).where("num <> least").select("doc_id", "num", F.col("least").alias("canonical"))


# --- reports -------------------------------------------------------------------------------------


def optimization_report(before: DataFrame, after: DataFrame, counts: str = "counts") -> DataFrame:
    """One row: files, bytes before and after, saved (signed) and percent, failures, and what passes took by name.

    `before` is (path, content), `after` a pass's output over the same paths.
    """
    # read twice, and a pass over all files is much work
    rows = checkpoint(before.select("path", F.octet_length("content").cast("long").alias("b")).join(after.select("path", F.octet_length("content").cast("long").alias("a"), counts, "error"), "path", "left"))
    took = rows.select(F.explode(counts).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("took"))  # one entry a label
    whole = rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum(F.coalesce("a", "b")), F.lit(0)).alias("bytes_after"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    saved = F.col("bytes_before") - F.col("bytes_after")
    return whole.withColumns({"saved": saved, "percent": F.when(F.col("bytes_before") == 0, 0.0).otherwise(saved * 100.0 / F.col("bytes_before"))}).crossJoin(took)  # one row each


def elidable_profiles(profiles: DataFrame, least: int = 32 << 10, share: int = 50) -> DataFrame:
    """Colour profiles with an alternate whose bytes are worth leaving out: `least`, or a `share`-th of the file, whichever is more."""
    return profiles.where(F.col("alternate").isNotNull() & (F.col("bytes") >= F.greatest(F.lit(least).cast("long"), F.floor(F.col("file_bytes") / share))))
