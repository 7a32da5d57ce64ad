"""Reserved types, identities and the two-level schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reserved entity types and relations of the structure and bridge layers.
DOCUMENT, SECTION, SEGMENT, UNCLASSIFIED = "文档", "章节", "文档片段", "未归类片段"
NEXT_SEGMENT, NEXT_SECTION, IN_DOCUMENT, IN_SECTION = "下一段", "下一节", "属于文档", "属于章节"
MENTIONED_IN, CO_OCCURS = "提及于", "共现"
DOCUMENT_NODES = (DOCUMENT, SECTION, SEGMENT, UNCLASSIFIED)
RESERVED_ENTITIES = (*DOCUMENT_NODES, "未分类实体", "未知类型")
STRUCTURE_EDGES = (NEXT_SEGMENT, NEXT_SECTION, IN_DOCUMENT, IN_SECTION)
BRIDGE_EDGES = (MENTIONED_IN, CO_OCCURS)
RESERVED_RELATIONS = (*STRUCTURE_EDGES, *BRIDGE_EDGES)
#: The separator of identity parts, the pseudo source of imported graphs, and limits.
SEPARATOR = "␟"
COLD_START = "cold_start"
MAX_QUOTES, MAX_QUOTE_CHARS, FAN_OUT, CO_OCCURRENCE = 8, 300, 15, 10

QUOTES = "array<struct<chunk_id:string,quote:string,verified:boolean>>"


def identity(prefix: str, *parts: Column | str) -> Column:
    """prefix + 24 hex digits of the SHA-1 of the parts; the separator is a literal, since chr() wraps at 256."""
    joined = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws(SEPARATOR, *joined)), 1, 24))


def node_id(entity_type: Column | str, name: Column | str) -> Column:
    return identity("n_", entity_type, name)


def edge_id(source: Column | str, relation: Column | str, target: Column | str) -> Column:
    return identity("e_", source, relation, target)


def packed(value: Column | str) -> Column:
    """An id as bytes, half as long, for shuffles: its letter and the bytes of its digits; any other text after a zero."""
    text = F.col(value) if isinstance(value, str) else value
    short = F.concat(F.substring(text, 1, 1).cast("binary"), F.unhex(F.substring(text, 3, 24)))
    return F.when(unpacked(short) == text, short).otherwise(F.concat(F.lit(b"\0"), text.cast("binary")))


def unpacked(value: Column | str) -> Column:
    """The id that ``packed`` was given."""
    short = F.col(value) if isinstance(value, str) else value
    head, rest = F.substring(short, 1, 1), short.substr(F.lit(2), F.length(short))
    return F.when(head == F.lit(b"\0"), rest.cast("string")).otherwise(F.concat(head.cast("string"), F.lit("_"), F.lower(F.hex(rest))))


def chunk_id(doc: Column, index: Column) -> Column:
    """Chunk ids follow from the document and position, so retries give the same ids."""
    return identity("c_", doc.cast("string"), index.cast("string"))


def allows(constraint: Column, kind: Column) -> Column:
    """An empty or missing constraint accepts every type."""
    return F.coalesce(F.size(constraint) == 0, F.lit(True)) | F.coalesce(F.array_contains(constraint, kind), F.lit(False))


def format_constraint(constraint: Column) -> Column:
    return F.when(F.coalesce(F.size(constraint), F.lit(0)) == 0, F.lit("*")).otherwise(F.array_join(F.array_sort(constraint), "/"))


def prune(entities: DataFrame, relations: DataFrame, targets: list[str], wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entity types a document targets, and the relations asked for or whose non-empty ends meet the targets."""
    goal = F.array(*map(F.lit, targets))
    meets = lambda c: F.size(c).__gt__(0) & F.arrays_overlap(c, goal)
    kept = F.col("name").isin(wanted) if wanted else meets(F.col("source_types")) & meets(F.col("target_types"))
    return entities.where(F.col("name").isin(targets)), relations.where(kept)


def undeclared_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(relation, side, type) of ends that are no declared entity type."""
    side = lambda c, s: relations.select(F.col("name").alias("relation"), F.lit(s).alias("side"), F.explode(c).alias("type"))
    ends = side("source_types", "source").union(side("target_types", "target"))
    return ends.join(entities.select(F.col("name").alias("type")), "type", "left_anti").select("relation", "side", "type")


def merge_schema(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Additive merge: a known name wins, new names are appended; both: name, definition."""
    return known.select("name", "definition").union(fresh.join(known.select("name"), "name", "left_anti").dropDuplicates(["name"]).select("name", "definition"))
