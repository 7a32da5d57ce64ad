"""Schema evolution without a model: schemas read off graphs, placeholders for gaps, repaired ends, defaults and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.governance import end_types, most_frequent_ends
from graphloom.schema import RESERVED_RELATIONS
from graphloom.session import materialize, small

#: Names looked at for a type, examples kept, and the schema suggested where nothing is known.
SAMPLES, EXAMPLES = 5, 3
#: Different numbers of words that the terms of a dictionary may have.
LENGTHS = 50
#: Most first words of terms by which the words of a chunk are looked through before runs are made.
FIRST_WORDS = 5_000
DEFAULT_ENTITIES = (("人物", "自然人", "张三"), ("组织", "机构或组织", "公司A"), ("地点", "地理位置", "北京"))
DEFAULT_RELATIONS = (("就职于", "人物在组织工作", "人物", "组织"), ("位于", "实体的地理位置", "组织", "地点"))
#: Colours of types in turn; our own palette.
COLOURS = ("#4477aa", "#66ccee", "#228833", "#ccbb44", "#ee6677", "#aa3377", "#bbbbbb", "#332288", "#88ccee", "#44aa99")


def coloured(types: DataFrame, first: int = 0) -> DataFrame:
    """Adds colour, in turn by name; a schema has a few hundred types. ``first`` goes on where known types end."""
    place = F.row_number().over(Window.orderBy("name")) - 1 + first
    return types.withColumn("colour", F.get(F.array(*map(F.lit, COLOURS)), (place % len(COLOURS)).cast("int")))


def samples(nodes: DataFrame, most: int = SAMPLES) -> DataFrame:
    """(entity_type, names): the first names of each type by seq."""
    named = nodes.where((F.trim(F.coalesce("entity_type", F.lit(""))) != "") & (F.coalesce("name", F.lit("")) != ""))
    place = F.row_number().over(Window.partitionBy("entity_type").orderBy("seq"))
    few = named.withColumn("_n", place).where(F.col("_n") <= most)
    return few.groupBy("entity_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]).alias("names"))


def of_kind(rows: DataFrame, column: str, n: int, order: str = "seq") -> DataFrame:
    """The first ``n`` nodes of every type, or edges of every relation."""
    place = F.row_number().over(Window.partitionBy(column).orderBy(order))
    return rows.withColumn("rank", place).where(F.col("rank") <= n)


def reverse_schema(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The schema that a graph follows: entity types with examples and colours; relations with their most frequent ends.

    Definitions only say where a type comes from."""
    said = lambda c, kind: F.concat(F.lit("从导入图谱中识别出的「"), c, F.lit(f"」{kind}。"))
    types = samples(nodes).select(F.col("entity_type").alias("name"), said(F.col("entity_type"), "类型实体").alias("definition"), F.slice("names", 1, EXAMPLES).alias("examples"))
    counted = materialize(end_types(edges, nodes))  # a row for each relation and pair of types
    ends = most_frequent_ends(counted.where("_from AND _to")).select(F.col("relation_type").alias("name"), "source_type", "target_type")
    known = counted.where(F.trim(F.coalesce("relation_type", F.lit(""))) != "").select(F.col("relation_type").alias("name")).distinct()
    relations = known.join(ends, "name", "left").select("name", said(F.col("name"), "关系").alias("definition"), F.coalesce("source_type", F.lit("")).alias("source_type"), F.coalesce("target_type", F.lit("")).alias("target_type"))
    return coloured(types), relations


def repaired(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose undeclared ends became unconstrained; source_type and target_type."""
    declared = small(entities.select(F.col("name").alias("_t")).distinct())
    for end in ("source_type", "target_type"):
        relations = relations.join(declared.withColumn("_known", F.lit(True)), F.col(end) == F.col("_t"), "left").withColumn(end, F.when(F.col("_known"), F.col(end)).otherwise("")).drop("_t", "_known")
    return relations


def placeholders(gaps: DataFrame, kind: str = "类型", key: str = "entity_type") -> DataFrame:
    """Definitions for types that a schema lacks: name, definition, examples."""
    return gaps.select(F.col(key).alias("name"), F.concat(F.lit("图谱中出现的「"), F.col(key), F.lit(f"」{kind}")).alias("definition"), F.split("examples", r"\|").alias("examples"))


def merged(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known types, then new names by order with colours that go on in turn; both: name, definition (known: colour too)."""
    new = fresh.where(F.trim(F.coalesce("name", F.lit(""))) != "").select(F.trim("name").alias("name"), "definition").join(known.select("name"), "name", "left_anti").groupBy("name").agg(F.min("definition").alias("definition"))
    return known.select("name", "definition", "colour").union(coloured(new, known.count()).select("name", "definition", "colour"))


def suggested(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The schema to begin with where no model suggests one."""
    types = spark.createDataFrame([(n, d, [e]) for n, d, e in DEFAULT_ENTITIES], "name string, definition string, examples array<string>")
    return coloured(types), spark.createDataFrame(DEFAULT_RELATIONS, "name string, definition string, source_type string, target_type string")


def semantics(types: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Types with abstractness and evidence_mode; answered degrees replace current ones if they are known degrees.

    types: name, abstractness; answers: name, abstractness."""
    known = F.col("_new").isin("surface", "normalized", "inductive")
    joined = types.withColumn("_new", F.lit(None).cast("string")) if answers is None else types.join(small(answers.groupBy("name").agg(F.min("abstractness").alias("_new"))), "name", "left")
    degree = F.coalesce(F.when(known, F.col("_new")), "abstractness", F.lit("surface"))
    return joined.withColumn("abstractness", degree).withColumn("evidence_mode", F.when(F.col("abstractness") == "inductive", "span").otherwise("verbatim")).drop("_new")


def document_profile(profiles: DataFrame, outlines: DataFrame) -> DataFrame:
    """(doc_id, profile) without a model: what is known of each file, in lines. profiles: doc_id, chunk_count, file_size;
    outlines: doc_id, rank, line."""
    heads = outlines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("heads"))
    text = F.concat_ws("\n", F.concat(F.lit("chunks: "), F.col("chunk_count").cast("string")), F.concat(F.lit("size: "), F.col("file_size").cast("string")), F.array_join("heads", "\n"))
    return profiles.join(heads, "doc_id", "left").select("doc_id", text.alias("profile"))


def domain_concepts(mapped: DataFrame) -> DataFrame:
    """(domain, concepts): the reduced profile: domains by name with their distinct concepts; mapped: domain, concept."""
    return mapped.where("domain IS NOT NULL").groupBy("domain").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))


def judged(items: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Induced items that a faithfulness judge lets pass; items without a verdict, or without a judge, pass.

    items: name; verdicts: name, supported."""
    if verdicts is None:
        return items
    bad = verdicts.groupBy("name").agg(F.bool_and("supported").alias("_ok")).where("NOT _ok").select("name")
    return items.join(bad, "name", "left_anti").select(*items.columns)


def propose(chunks: DataFrame, terms: DataFrame, text: Column | None = None) -> DataFrame:
    """Entity proposals of dictionary terms that stand in a chunk: the deterministic proposer.

    chunks: chunk_id, chunk; terms: term, entity_type (a dictionary of checked size). Evidence is the line of the term."""
    pairs = chunks.join(small(terms.select("term", "entity_type").distinct()), F.lower(text if text is not None else F.col("chunk")).contains(F.lower("term")))
    line = F.get(F.filter(F.split("chunk", "\n"), lambda x: F.lower(x).contains(F.lower("term"))), F.lit(0))
    return pairs.select("chunk_id", F.col("term").alias("name"), "entity_type", F.trim(line).alias("evidence"), F.lit(0.9).alias("confidence"))


def dictionary_words(text: Column) -> Column:
    """Runs of letters and digits, in lower case, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def dictionary_mentions(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk_id, at, words, term, entity_type): at each word of a chunk the longest term that begins there, if any.

    chunks: chunk_id, chunk; terms: term, entity_type. Terms and chunks are compared by whole words, so a term never
    matches inside one; terms of equal words all count. A chunk gives a row for each word that begins a term (any word, if
    terms begin with more than ``FIRST_WORDS``) and each number of words that a term has, which meet the dictionary by a
    join: broadcast while it is proven small, dealt by words beyond that. So any number of terms will do. Terms and chunks without words match nothing."""
    listed = terms.select("term", "entity_type", dictionary_words(F.col("term")).alias("w")).where(F.size("w") > 0).distinct()
    listed = listed.select("term", "entity_type", F.size("w").alias("words"), F.array_join("w", " ").alias("key"))
    lengths = sorted(r["words"] for r in listed.select("words").distinct().limit(LENGTHS + 1).collect())
    if len(lengths) > LENGTHS:
        raise ValueError(f"terms have more than {LENGTHS} different numbers of words")
    begin = [r["f"] for r in listed.select(F.split("key", " ")[0].alias("f")).distinct().limit(FIRST_WORDS + 1).collect()]
    starts = F.sequence(F.lit(1), F.size("w"))
    if len(begin) <= FIRST_WORDS:
        starts = F.filter(starts, lambda i: F.get("w", i - 1).isin(begin))
    runs = lambda k: F.transform(F.filter("s", lambda i: i <= F.size("w") - (k - 1)), lambda i: F.struct(i.alias("at"), F.lit(k).alias("words"), F.array_join(F.slice("w", i, k), " ").alias("key")))
    none = F.array().cast("array<struct<at:int,words:int,key:string>>")
    cut = chunks.select("chunk_id", dictionary_words(F.col("chunk")).alias("w")).where(F.size("w") > 0).withColumn("s", starts)
    rows = cut.select("chunk_id", F.explode(F.concat(none, *[runs(k) for k in lengths])).alias("r")).select("chunk_id", "r.*")
    met = rows.join(small(listed), ["words", "key"])
    longest = F.max("words").over(Window.partitionBy("chunk_id", "at"))
    return met.withColumn("_longest", longest).where("words = _longest").select("chunk_id", "at", "words", "term", "entity_type")


def propose_relations(proposals: DataFrame, relations: DataFrame, most: int = 50) -> DataFrame:
    """Relation proposals of a chunk's proposed entities whose types a declared relation connects.

    proposals: chunk_id, name, entity_type; relations: name, source_type, target_type. A chunk with more than ``most``
    entities proposes none, as it is a list and not a statement; the bound keeps pairs of a chunk at ``most`` squared."""
    one = proposals.select("chunk_id", "name", "entity_type").distinct()
    fit = one.groupBy("chunk_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("chunk_id")
    rows = one.join(fit, "chunk_id", "left_semi")
    side = lambda s: rows.select("chunk_id", F.col("name").alias(f"{s}_name"), F.col("entity_type").alias(f"{s}_type"))
    declared = small(relations.where(~F.col("name").isin(*RESERVED_RELATIONS)).select(F.col("name").alias("relation_type"), "source_type", "target_type"))
    return side("source").join(declared, "source_type").join(side("target"), ["chunk_id", "target_type"]).where("source_name <> target_name").select("chunk_id", "source_name", "target_name", "relation_type")
