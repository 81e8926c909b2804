"""Sources: git logs, Markdown, Python code, text batches, seed packs; sinks that add what is new."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.text import chunks, entity_key, headings, links, slug, technologies, text_key

MARKDOWN_HEAD, MOST_HEADINGS = 4000, 20


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """hash, author_name, author_email, authored_at, message, files: a log written with record marks \\x1e, field marks \\x1f and --name-only."""
    records = spark.read.text(path, lineSep="\x1e").filter(F.trim(F.regexp_replace("value", r"\n", " ")) != "")
    lines = F.split(F.regexp_replace("value", r"^\n+|\n+$", ""), "\n")
    fields = F.split(lines[0], "\x1f")
    files = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")
    rows = records.select(fields.alias("f"), files.alias("files")).filter(F.size("f") >= 5)
    return rows.select(*[F.col("f")[i].alias(n) for i, n in enumerate(("hash", "author_name", "author_email", "authored_at", "message"))], "files")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, title, headings, technologies, links, head (4000 characters at most) of every .md file below the path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("path", F.input_file_name())
    heads = headings(F.col("value"))
    return files.select("path", F.try_element_at(heads, F.lit(1)).alias("title"), heads.alias("headings"), technologies(F.col("value")).alias("technologies"), links(F.col("value")).alias("links"), F.substring("value", 1, MARKDOWN_HEAD).alias("head"))


def readme_seeds(docs: DataFrame, project: Column, text: str) -> DataFrame:
    """subject, predicate, object, object_key: the technologies and first 20 headings that a text names."""
    tech = docs.select(project.alias("subject"), F.lit("uses_tech").alias("predicate"), F.explode(technologies(F.col(text))).alias("object")).withColumn("object_key", F.concat(F.lit("tech:"), F.lower("object")))
    parts = docs.select(project.alias("subject"), F.lit("has_section").alias("predicate"), F.explode(F.slice(headings(F.col(text)), 1, MOST_HEADINGS)).alias("object")).withColumn("object_key", entity_key("concept", F.col("object")))
    return tech.unionByName(parts).distinct()


def _outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path, text in zip(b.path, b.value, strict=True):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError):
                first = [x.lstrip("# ").strip() for x in (text or "").splitlines()[:10] if x.startswith("#")]
                out.append((path, " ".join(first), [], [], []))
                continue
            names = lambda *kinds: [n.name for n in tree.body if isinstance(n, kinds)]  # noqa: B023, E731
            deps = {a.name.split(".")[0] for n in tree.body if isinstance(n, ast.Import) for a in n.names} | {("." * n.level) + (n.module or "").split(".")[0] for n in tree.body if isinstance(n, ast.ImportFrom)}
            out.append((path, ast.get_docstring(tree) or "", names(ast.ClassDef), names(ast.FunctionDef, ast.AsyncFunctionDef), sorted(deps)))
        yield pd.DataFrame(out, columns=["path", "docstring", "classes", "functions", "imports"])


def python_code(files: DataFrame) -> DataFrame:
    """path, docstring, classes, functions, imports of Python sources (columns path, value); of what doesn't parse the comment at its head."""
    return files.select("path", "value").mapInPandas(_outline, "path string, docstring string, classes array<string>, functions array<string>, imports array<string>")


def code_seeds(outlines: DataFrame) -> DataFrame:
    """subject, predicate, object, object_key of classes and dependencies."""
    stem = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    classes = outlines.select(F.col("path").alias("subject"), F.lit("defines_class").alias("predicate"), F.explode("classes").alias("c"), stem.alias("stem"))
    classes = classes.select("subject", "predicate", F.concat_ws(".", "stem", "c").alias("object"), F.concat(F.lit("class:"), slug(F.col("subject")), F.lit("-"), slug(F.col("c"))).alias("object_key"))
    deps = outlines.select(F.col("path").alias("subject"), F.lit("depends_on").alias("predicate"), F.explode("imports").alias("object"))
    inner = F.col("object").startswith(".")
    return classes.unionByName(deps.withColumn("object_key", F.when(inner, F.concat(F.lit("file:"), slug(F.col("object")))).otherwise(entity_key("tech", F.col("object")))))


def text_batch(df: DataFrame, text: str, most: int = 2000) -> DataFrame:
    """fragment_id, content: texts in pieces of whole lines, keyed by their hash; equal pieces are one."""
    pieces = df.select(F.explode(chunks(F.col(text), most)).alias("content"))
    return pieces.select(text_key(F.col("content")).alias("fragment_id"), "content").dropDuplicates(["fragment_id"])


def seed_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and triples of a small JSON file with the lists `entities` and `triples`, or of a YAML file if PyYAML is installed."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if PurePosixPath(path).suffix == ".json":
        pack = json.loads(text)
    else:
        import yaml

        pack = yaml.safe_load(text)
    rows = lambda items, names: [tuple(i.get(n) for n in names) for i in items]
    e, t = ("name", "entity_type", "entity_id"), ("subject", "predicate", "object_name", "object_value")
    entities = spark.createDataFrame(rows(pack.get("entities", []), e), "name string, entity_type string, entity_id string")
    entities = entities.withColumn("entity_id", F.coalesce("entity_id", entity_key("concept", F.col("name"))))
    return entities, spark.createDataFrame(rows(pack.get("triples", []), t), ", ".join(f"{n} string" for n in t))


def new_rows(incoming: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Of the incoming rows those whose keys the table lacks, each key once (null keys are equal): what an idempotent sink appends."""
    names = [f"_k{i}" for i in range(len(keys))]
    known = have.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    return incoming.dropDuplicates(keys).join(known, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left_anti")


def lookup(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """id, content, found_in: the text of each id (fragments: content; entities: name (type); triples: subject predicate object); of an id in several tables the text of the last."""
    f, e, t = tables["temporal_fragments"], tables["entities"], tables["triples"]
    thing = F.coalesce(F.when(F.length("object_id") > 0, F.col("object_id")), F.when(F.length("object_value") > 0, F.col("object_value")), F.lit("?"))
    each = [
        (f, F.col("content"), "temporal_fragments"),
        (e, F.concat(F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit(")")), "entities"),
        (t, F.concat_ws(" ", "subject_id", "predicate", thing), "triples"),
    ]
    wanted = ids.select("id").distinct()
    rows = None
    for i, (df, text, name) in enumerate(each):
        part = df.join(wanted, "id", "left_semi").select("id", F.struct(F.lit(i).alias("i"), text.alias("content"), F.lit(name).alias("found_in")).alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.max("x").alias("x")).select("id", "x.content", "x.found_in")
