"""Texts, picture references and recognition scores of nested attachments, walked as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueforge.functions import text as T
from clueforge.session import materialise

#: Text fields of a record and of what is attached to it, references to pictures, collections that may nest, scores, and fields of recognised text.
TEXT = "content_text clean_text text raw_text caption ocr_text alt_text image_ocr_text poster_text subtitle_text".split()
ATTACHED = "ocr_text alt_text caption description image_ocr_text poster_text subtitle_text text".split()
MEDIA = "image_url poster_url poster_image_url screenshot_ref screenshot_url image_path".split()
NESTED = "attachments media images screenshots albums cards frames ocr_blocks text_blocks".split()
SCORES = "ocr_confidence confidence text_confidence".split()
RECOGNISED = "ocr_text image_ocr_text alt_text poster_text subtitle_text".split()
PRIMARY = ("content_text", "clean_text", "text", "raw_text")
PICTURED = "ocr|image|photo|poster|screenshot|caption|alt_text"

#: Levels of attachments under a record that are read.
DEPTH = 4


def _field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("node", f"$.{name}", kind)


def score_of(raw: Column) -> Column:
    """A score between 0 and 1, from a number or a percentage; null where it is neither."""
    bare = F.trim(F.regexp_replace(F.trim(raw), "%+$", ""))
    number = bare.try_cast("double")
    share = F.when(number > 1, number / 100).otherwise(number)
    return F.when(~F.lower(bare).isin("true", "false") & (share >= 0) & (share <= 1), share)


def _children(level: DataFrame) -> DataFrame:
    """What is attached to the nodes of a level, in order; a single object counts as a list of one."""
    listed = []
    for at, name in enumerate(NESTED):
        value = _field(name, "variant")
        shape = F.schema_of_variant(value)
        items = F.when(shape.startswith("ARRAY"), _field(name, "array<variant>")).when(shape.startswith("OBJECT"), F.array(value))
        listed.append(F.struct(F.lit(at).alias("at"), F.lit(name).alias("name"), items.alias("items")))
    rows = level.select("id", "path", "prefix", F.explode(F.array(*listed)).alias("c")).where(F.size("c.items") > 0)
    rows = rows.select("id", "path", "prefix", "c.at", "c.name", F.posexplode("c.items").alias("pos", "node"))
    return rows.select("id", F.concat("path", F.array(F.lit(1), "at", "pos")).alias("path"), F.concat("prefix", F.col("name"), F.lit(".")).alias("prefix"), "node")


def folded(records: DataFrame) -> DataFrame:
    """id, content_text, sources, references, modality, confidence of records (id, json).

    Texts come in the order of a walk that takes a node's own fields first and then
    what is attached to it. Sources and references are the fields' names behind
    those of their collections; an attachment that has neither field nor attachment
    of its own counts by its collection. Attachments below the DEPTH-th level are
    not read, and count by their collection. Scores count where a node has a text
    and either a score of recognition or recognised text. A level is one pass over
    the nodes of the level above; a record's own parts meet in one row. Records
    that are null or no JSON object are texts without anything. Ids are distinct.
    """
    none = F.array().cast("array<int>")
    level = records.select("id", none.alias("path"), F.lit("").alias("prefix"), F.try_parse_json("json").alias("node"))
    parts = None
    for depth in range(DEPTH + 2):
        level = materialise(level, "nodes")
        if depth and not level.limit(1).count():
            break
        fields = (TEXT if depth == 0 else ATTACHED) if depth <= DEPTH else []
        children = _children(level) if depth <= DEPTH else None
        raw = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), _field(f).alias("value")) for i, f in enumerate(fields)]).cast("array<struct<i: int, field: string, value: string>>")
        texts = F.filter(F.transform(raw, lambda t: F.struct(t["i"].alias("i"), t["field"].alias("field"), T.normalize_text(t["value"]).alias("value"))), lambda t: t["value"] != "")
        refers_to = F.array(*[F.struct(F.lit(f).alias("field"), _field(f).alias("value")) for f in (MEDIA if depth <= DEPTH else [])]).cast("array<struct<field: string, value: string>>")
        media = F.transform(F.filter(refers_to, lambda m: m["value"] != ""), lambda m: m["field"])
        scores = F.filter(F.transform(F.array(*[_field(f) for f in SCORES]), score_of), lambda v: v.isNotNull())
        named = F.transform("texts", lambda t: t["field"])
        counts = (score_of(_field("ocr_confidence")).isNotNull() | F.arrays_overlap(named, F.array(*map(F.lit, RECOGNISED)))) & (F.size("texts") > 0)
        nodes = level.withColumn("texts", texts).withColumns({"media": media, "scores": F.when(counts, scores).otherwise(F.array().cast("array<double>"))})
        if children is not None:
            has = children.select("id", F.slice("path", 1, 3 * depth).alias("path")).distinct().withColumn("inner", F.lit(True))
            nodes = nodes.join(has, ["id", "path"], "left")
        else:
            nodes = nodes.withColumn("inner", F.lit(None).cast("boolean"))
        own = F.expr("substring(prefix, 1, length(prefix) - 1)")
        bare = F.col("inner").isNull() & (F.lit(depth) > 0)
        behind = lambda names: F.transform(names, lambda n: F.concat("prefix", n))
        kept = nodes.select(
            "id",
            F.transform("texts", lambda t: F.struct(F.concat(F.col("path"), F.array(F.lit(0), t["i"])).alias("at"), t["value"].alias("value"))).alias("texts"),
            F.when(bare & (F.size("texts") == 0), F.array(own)).otherwise(behind(named)).alias("sources"),
            F.when(bare & (F.size("media") == 0), F.array(own)).otherwise(behind(F.col("media"))).alias("refs"),
            "scores",
        )
        parts = kept if parts is None else parts.unionByName(kept)
        if children is None:
            break
        level = children
    whole = parts.groupBy("id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("texts", "sources", "refs", "scores")])
    out = whole.select(
        "id",
        T.normalize_text(F.array_join(F.transform(F.array_sort("texts"), lambda t: t["value"]), " ")).alias("content_text"),
        F.array_sort(F.array_distinct("sources")).alias("sources"),
        F.array_sort(F.array_distinct("refs")).alias("references"),
        F.when(F.size("scores") > 0, F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores"), 4)).alias("confidence"),
    )
    pictured = F.exists("sources", lambda s: s.rlike(PICTURED))
    primary = F.arrays_overlap("sources", F.array(*map(F.lit, PRIMARY)))
    refers = F.size("references") > 0
    modality = F.when((pictured | refers) & primary, "mixed").when(pictured, "image_text").when(refers, "image_reference").otherwise("text")
    return out.withColumn("modality", modality)
