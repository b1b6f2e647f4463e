"""Reading and writing the text files of the graph tools, and the parquet edge store queries read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pathweave.functions.automaton import Automaton
from pathweave.session import settle, small

EDGE_COLUMNS = {"sdl": ["src", "dst", "label"], "sld": ["src", "label", "dst"]}


def read_edges(spark: SparkSession, path: str, order: str = "sdl", label_type: str = "string") -> DataFrame:
    """Blank-separated edge lines, ``src dst label`` or ``src label dst``, as the set of edges."""
    kinds = {"src": "bigint", "dst": "bigint", "label": label_type}
    schema = ", ".join(f"{c} {kinds[c]}" for c in EDGE_COLUMNS[order])
    lines = spark.read.csv(path, sep=" ", schema=schema)
    return lines.select("src", "label", "dst").distinct()


def write_edges(edges: DataFrame, path: str, order: str = "sdl") -> None:
    edges.select(*EDGE_COLUMNS[order]).write.csv(path, sep=" ")


def read_layers(spark: SparkSession, layers: dict[int, str]) -> DataFrame:
    """Layer files ``src,dst,...`` with ids from 1; the layer's number becomes the label and ids start at 0."""
    edges = None
    for label, path in layers.items():
        rows = spark.read.csv(path, schema="src bigint, dst bigint")
        layer = rows.select((F.col("src") - 1).alias("src"), F.lit(label).alias("label"), (F.col("dst") - 1).alias("dst"))
        edges = layer if edges is None else edges.unionByName(layer)
    return edges.distinct()


def store_edges(edges: DataFrame, path: str) -> DataFrame:
    """The set of edges as parquet clustered by label: row-group statistics let a label predicate skip the rest."""
    by_label(edges).write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path)


def by_label(edges: DataFrame) -> DataFrame:
    """Distinct edges, dealt out once, in ranges over ``(label, src, dst)``: a label or hub of any size spreads over many
    files, and equal edges lie in one. There they follow each other, so the one sort tells them and no table is held."""
    by = ["label", "src", "dst"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*by))
    rows = edges.repartitionByRange(*by).withColumn("_nth", first)
    return rows.where("_nth = 1").drop("_nth").sortWithinPartitions(*by)


#: Folders of a table stored by source.
FOLDERS = 256


#: Level of an index of signatures whose blocks are kept together in one folder, with all levels below them.
SUBTREE = 10


def _folder(src: str | Column) -> Column:
    return F.pmod(F.xxhash64(src), F.lit(FOLDERS)).cast("int")


def store_edges_by_source(edges: DataFrame, path: str) -> DataFrame:
    """Edges in ``FOLDERS`` folders by their source, sorted by label inside, with the column ``folder``.

    Few sources are then looked up in few folders. Ranges go over whole edges, so that a hub of any size is many tasks and
    files.
    """
    by = ["folder", "label", "src", "dst"]
    rows = edges.withColumn("folder", _folder("src"))
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("folder").parquet(path)
    schema = StructType([*edges.schema.fields, StructField("folder", IntegerType())])
    return edges.sparkSession.read.schema(schema).parquet(path)


def folders_of(node: str | Column, edges: DataFrame) -> dict[str, Column]:
    """Aggregates that tell in which folders of ``edges`` the sources ``node`` lie, as bits; none for another table."""
    if "folder" not in edges.columns:
        return {}
    folder = _folder(node)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(folder, F.lit(64)))
    return {f"folders_{i}": F.bit_or(F.when(F.floor(folder / 64) == i, bit).otherwise(F.lit(0).cast("bigint"))) for i in range(FOLDERS // 64)}


def in_folders(edges: DataFrame, seen: dict) -> DataFrame:
    """``edges`` of the folders found; the others aren't listed among the files to read."""
    if "folder" not in edges.columns:
        return edges
    held = [64 * i + b for i in range(FOLDERS // 64) for b in range(64) if (seen.get(f"folders_{i}") or 0) >> b & 1]
    return edges.where(F.col("folder").isin(held))


def _words(spark: SparkSession, path: str) -> DataFrame:
    # generated, so that conditions on words aren't pushed below, where each would split the line once more
    words = F.explode(F.array(F.split(F.trim("value"), r"\s+")))
    return spark.read.text(path).select(words.alias("w")).where("w[0] <> ''")


def read_transitions(spark: SparkSession, path: str, label_type: str = "string") -> DataFrame:
    """Transitions ``(q, label, t)`` from the lines ``from to label``."""
    w = F.col("w")
    steps = _words(spark, path).where(F.size(w) == 3)
    return steps.select(
        w[0].cast("int").alias("q"), w[2].cast(label_type).alias("label"), w[1].cast("int").alias("t")
    ).distinct()


def read_n_states(spark: SparkSession, path: str) -> int:
    """First word of the first line of at most two words."""
    header = _words(spark, path).where(F.size("w") <= 2).first()
    if header is None:
        raise ValueError(f"no line with the number of states in {path}")
    return int(header["w"][0])


def read_start_node(spark: SparkSession, path: str) -> DataFrame:
    """Second word of the two-word line, as a one-row table ``node``."""
    header = _words(spark, path).where(F.size("w") == 2)
    return header.select(F.col("w")[1].cast("bigint").alias("node")).limit(1)


def read_automaton(spark: SparkSession, path: str, label_type: str = "int") -> Automaton:
    """A query automaton: part of the question, and held by the driver like it. Joins broadcast it only if it is small."""
    steps = read_transitions(spark, path, label_type).collect()
    return Automaton(tuple(sorted((s["q"], s["label"], s["t"]) for s in steps)), read_n_states(spark, path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their position in the file, ``(node, line)`` from 0; files of a folder follow each other by name.

    A split of a file is read in order by one task, so a line's position is its place among the split's lines and the
    number of lines in earlier splits. Only those counts, one row per split, pass through one task.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", file.alias("_file"), start.alias("_start"), F.monotonically_increasing_id().alias("_id"))
    lines, _ = settle(lines)
    splits = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits, seen = settle(splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    placed = lines.join(small(splits, seen), ["_file", "_start"])
    return placed.select((F.col("_id") - F.col("_first") + F.col("_before")).alias("node"), F.col("value").alias("line"))


def read_numbered_lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One number per line; the line's position in the file is the node id."""
    return read_lines(spark, path).select("node", F.col("line").cast("int").alias(column))


def write_numbered_lines(table: DataFrame, path: str, column: str) -> None:
    """``column`` of ``(node, column)`` in node order, part files in name order forming the whole file."""
    table.orderBy("node").select(F.col(column).cast("string").alias("value")).write.text(path)


def write_colouring(colouring: DataFrame, path: str) -> None:
    """Stored with the node ids, so that nothing depends on line order; text export is ``write_numbered_lines``."""
    colouring.select("node", "colour").write.parquet(path)


def read_colouring(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node bigint, colour int").parquet(path)


def write_signatures(signatures: DataFrame, path: str) -> None:
    """Lines ``block l1,l2,...`` in one folder per level. A line holds at most every label once."""
    labels = F.array_join(F.sort_array(F.collect_list("label")), ",")
    lines = signatures.groupBy("level", "block").agg(labels.alias("labels"))
    lines = lines.select("level", F.concat_ws(" ", F.col("block").cast("string"), "labels").alias("value"))
    lines.write.partitionBy("level").text(path)


def store_signatures(signatures: DataFrame, path: str) -> DataFrame:
    """``(level, block, label)`` as parquet in folders by level and, below level ``SUBTREE``, by a hash of the block of that
    level they lie in, for ``signature_descent``; sorted by label inside.

    Ranges go over whole rows, so that no level, subtree or label is one task.
    """
    root = F.expr(f"shiftright(block, greatest({SUBTREE} - level, 0))")
    folder = F.when(F.col("level") <= SUBTREE, _folder(root)).otherwise(F.lit(0))
    by = ["level", "folder", "label", "block"]
    rows = signatures.withColumn("folder", folder)
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("level", "folder").parquet(path)
    kind = signatures.schema["label"].dataType.simpleString()
    return signatures.sparkSession.read.schema(f"block bigint, label {kind}, level int, folder int").parquet(path)


def read_signatures(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """Signature files in long form ``(level, block, label)``.

    The level is the file's number (``13.txt``) or its folder's (``level=13``); give ``level`` to read only one folder.
    """
    source = path if level is None else f"{path}/level={level}"
    lines = spark.read.option("recursiveFileLookup", "true").text(source).select("value", F.input_file_name().alias("f"))
    in_folder = F.regexp_extract("f", r"level=(\d+)/", 1)
    number = F.when(in_folder != "", in_folder).otherwise(F.regexp_extract("f", r"(\d+)\.txt$", 1))
    words = F.split("value", " ")
    return lines.where("value <> ''").select(
        number.cast("int").alias("level"),
        words[0].cast("bigint").alias("block"),
        F.explode(F.split(words[1], ",").cast("array<int>")).alias("label"),
    )
