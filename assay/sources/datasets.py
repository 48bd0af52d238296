"""Datasets of examples from JSON, CSV, memory and other datasets, and resolvers of dataset URIs.

A dataset is a DataFrame (example_idx, inputs, expected_outputs, metadata) with maps of JSON texts flattened to strings,
and a name. Files are read by Spark, so a path may be in any store that it reads.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DatasetResolutionError
from ..functions import typed
from ..functions.scalar import strip
from ..shared import size

SCHEMA = "example_idx long, inputs map<string,string>, expected_outputs map<string,string>, metadata map<string,string>"
EXAMPLES = "array<struct<inputs:map<string,string>,expectedOutputs:map<string,string>,metadata:map<string,string>,input:string,expectedOutput:string>>"
RAW = f"struct<name:string,description:string,examples:{EXAMPLES}>"
OUTPUT_ALIASES = ("expectedoutput", "expected_output", "output")


@dataclass
class Dataset:
    """A named, ordered set of examples."""

    frame: DataFrame
    name: str = "unnamed"
    description: str = ""

    def size(self) -> int:
        return self.frame.count()

    def get(self, i: int):
        rows = self.frame.where(F.col("example_idx") == i).take(1)
        if not rows:
            raise IndexError(i)
        return rows[0]

    def __iter__(self) -> Iterator:
        return self.frame.orderBy("example_idx").toLocalIterator()

    def add(self, other: Dataset) -> Dataset:
        """The examples of both, the other's last."""
        last = self.frame.agg(F.max("example_idx")).first()[0]
        moved = other.frame.withColumn("example_idx", F.col("example_idx") + (0 if last is None else last + 1))
        return Dataset(self.frame.unionByName(moved), self.name, self.description)


def normalized(e: Column) -> list[Column]:
    """inputs, expected_outputs and metadata of a parsed example: the long form wins over the short one."""
    empty = F.create_map().cast("map<string,string>")
    long_ = lambda c: F.coalesce(c, empty)
    short = lambda c, key, v: F.when((F.size(long_(c)) == 0) & v.isNotNull(), F.create_map(F.lit(key), v)).otherwise(long_(c))
    return [short(e["inputs"], "input", e["input"]).alias("inputs"), short(e["expectedOutputs"], "output", e["expectedOutput"]).alias("expected_outputs"), long_(e["metadata"]).alias("metadata")]


def _parsed(texts: DataFrame) -> Dataset:
    rows = texts.select(F.from_json("value", RAW, {"mode": "PERMISSIVE"}).alias("d"), F.try_parse_json("value").alias("v"))
    stop = lambda why: F.raise_error(F.lit(why)).cast(EXAMPLES)
    examples = F.when(F.col("v").isNull(), stop("Failed to parse JSON dataset")).when(F.col("d.examples").isNull(), stop("a dataset needs 'examples'")).otherwise(F.col("d.examples"))
    rows = rows.withColumn("examples", examples)
    head = rows.select("d.name", "d.description").first()
    frame = rows.select(F.posexplode("examples").alias("example_idx", "e")).select(F.col("example_idx").cast("long"), *normalized(F.col("e")))
    return Dataset(frame, (head.name if head else None) or "unnamed", (head.description if head else None) or "")


def from_json_text(spark: SparkSession, text: str) -> Dataset:
    return _parsed(spark.createDataFrame([(text,)], "value string"))


def typed_examples(texts: DataFrame) -> DataFrame:
    """(example_idx, inputs, expected_outputs, metadata) of JSON dataset texts (column value), with types kept: VARIANT objects.

    The long form wins over the short one, as in :func:`normalized`; what a text lacks is an empty object.
    """
    doc = F.coalesce(F.try_parse_json("value"), F.raise_error(F.lit("Failed to parse JSON dataset")).cast("variant"))
    examples = F.coalesce(F.try_variant_get(doc, "$.examples", "array<variant>"), F.raise_error(F.lit("a dataset needs 'examples'")).cast("array<variant>"))
    rows = texts.select(F.posexplode(examples).alias("example_idx", "e"))
    empty = F.parse_json(F.lit("{}"))
    given = lambda key: F.when(~F.coalesce(F.schema_of_variant(typed.field("e", key)).isin("OBJECT<>", "VOID"), F.lit(True)), typed.field("e", key))
    short = lambda key, name: F.when(typed.field("e", key).isNotNull(), F.to_variant_object(F.struct(typed.field("e", key).alias(name))))
    return rows.select(
        F.col("example_idx").cast("long"), F.coalesce(given("inputs"), short("input", "input"), empty).alias("inputs"), F.coalesce(given("expectedOutputs"), short("expectedOutput", "output"), empty).alias("expected_outputs"),
        F.coalesce(given("metadata"), empty).alias("metadata"),
    )


WHOLE = 16 << 20  # bytes of a JSON file that one task parses whole


def from_json(spark: SparkSession, path: str, whole: int = WHOLE) -> Dataset:
    """A JSON dataset file; one of more than ``whole`` bytes is cut into ranges that many tasks parse."""
    if size(spark, path) <= whole:
        return _parsed(spark.read.text(path, wholetext=True))
    from .json_ranges import members

    head, rows = members(spark, path, "examples")
    if not isinstance(head.get("examples"), list):
        raise ValueError("a dataset needs 'examples'")
    kind = EXAMPLES.removeprefix("array<").removesuffix(">")
    bad = F.try_parse_json("text").isNull()
    e = F.when(bad, F.raise_error(F.lit("Failed to parse JSON dataset")).cast(kind)).otherwise(F.from_json("text", kind))
    text = lambda key, other: head.get(key) if isinstance(head.get(key), str) else other
    return Dataset(rows.select(F.col("nth").alias("example_idx"), e.alias("e")).select("example_idx", *normalized(F.col("e"))), text("name", "unnamed"), text("description", ""))


def cells(line: Column | str, delimiter: str = ",") -> Column:
    """Cells of a line: a quote switches quoting and is dropped, a delimiter inside quotes stays; doubled quotes are no escape."""
    line = F.col(line) if isinstance(line, str) else line
    # every other part between quotes is outside of them
    parts = F.transform(F.split(line, '"', -1), lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(delimiter), F.lit("\0"))).otherwise(p))
    return F.transform(F.split(F.array_join(parts, ""), "\0", -1), strip)


def _column_index(header: list[str], *candidates: str) -> int:
    return next((i for i, h in enumerate(header) if h.lower() in candidates), -1)


def _rows(lines: DataFrame, header: list[str], delimiter: str) -> DataFrame:
    given, wanted = _column_index(header, "input"), _column_index(header, *OUTPUT_ALIASES)
    if given < 0:
        raise ValueError("a CSV dataset needs a column 'input'")
    rows = lines.select("example_idx", cells("value", delimiter).alias("c"))
    some = lambda at, key: F.when(F.size("c") > at, F.create_map(F.lit(key), F.col("c")[at])).otherwise(F.create_map().cast("map<string,string>"))
    rest = [i for i in range(len(header)) if i not in (given, wanted)]
    pairs = F.array(*(F.when(F.size("c") > i, F.struct(F.lit(header[i]).alias("key"), F.col("c")[i].alias("value"))) for i in rest)) if rest else F.array().cast("array<struct<key:string,value:string>>")
    kept = F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull()))
    return rows.select("example_idx", some(given, "input").alias("inputs"), (some(wanted, "output") if wanted >= 0 else F.create_map().cast("map<string,string>")).alias("expected_outputs"), kept.alias("metadata"))


def from_csv_text(spark: SparkSession, text: str, name: str = "unnamed", delimiter: str = ",") -> Dataset:
    lines = re.split(r"\r?\n", text)
    if not text.strip():
        raise ValueError("a CSV dataset must not be empty")
    header = [h.strip() for h in lines[0].split(delimiter)]
    body = [line for line in lines[1:] if line.strip()]
    return Dataset(_rows(spark.createDataFrame(list(enumerate(body)), "example_idx long, value string"), header, delimiter), name)


def from_csv(spark: SparkSession, path: str, delimiter: str = ",") -> Dataset:
    """A CSV file, named as the file is; its first line is the header. Lines are numbered in file order, from their places in partitions and the partitions' sizes."""
    lines = spark.read.text(path)
    kept = lines.where(F.trim("value") != "")
    if kept.isEmpty():
        raise ValueError("a CSV dataset must not be empty")
    header = [h.strip() for h in lines.first().value.split(delimiter)]
    placed = kept.select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    sizes = placed.groupBy("p").agg(F.count("*").alias("n"))  # a row for each part of the file
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    rows = placed.join(F.broadcast(before), "p").select((F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1) - 1).alias("example_idx"), "value").where("example_idx >= 0")
    return Dataset(_rows(rows, header, delimiter), path.rsplit("/", 1)[-1].replace(".csv", ""))


def _texts(values: dict) -> dict[str, str]:
    """Values as JSON shows them, texts as they are; nulls are left out."""
    return {k: v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False) for k, v in values.items() if v is not None}


def from_examples(spark: SparkSession, examples: list[dict], name: str = "unnamed", description: str = "") -> Dataset:
    """Examples in memory: dicts with inputs, expected_outputs and metadata, or input and expected_output."""
    rows = []
    for i, e in enumerate(examples):
        inputs = e.get("inputs") or ({"input": e["input"]} if "input" in e else {})
        wanted = e.get("expected_outputs") or ({"output": e["expected_output"]} if "expected_output" in e else {})
        rows.append((i, *(_texts(m) for m in (inputs, wanted, e.get("metadata") or {}))))
    return Dataset(spark.createDataFrame(rows, SCHEMA), name, description)


def texts_of(contents: Column | str) -> Column:
    """The texts of retrieved contents (structs with a text); those without one are left out; none for null."""
    return F.coalesce(F.transform(_with_text(contents), lambda d: d["text"]), F.array().cast("array<string>"))


def texts_with_metadata(contents: Column | str) -> Column:
    """Structs (text, metadata) of retrieved contents; those without a text are left out; none for null."""
    kept = F.transform(_with_text(contents), lambda d: F.struct(d["text"].alias("text"), d["metadata"].alias("metadata")))
    return F.coalesce(kept, F.array())


def _with_text(contents: Column | str) -> Column:
    return F.filter(contents, lambda d: d.isNotNull() & d["text"].isNotNull())


def test_cases(requests: DataFrame) -> DataFrame:
    """Rows (user_text, response, documents: array<struct<text>>) as cases; context only where there are documents."""
    texts = texts_of("documents")
    return requests.select(F.create_map(F.lit("input"), "user_text").alias("inputs"), F.col("response").alias("actual_output"), F.when(F.size(texts) > 0, texts).alias("context"))


def evaluation_responses(evals: DataFrame) -> DataFrame:
    """Evaluations as a caller of the request adapter gets them: passed, reason, and metadata with the score as a 32-bit number."""
    score = F.create_map(F.lit("score"), F.col("score").cast("float").cast("string"))
    known = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return evals.select(F.col("success").alias("pass"), "reason", F.map_concat(F.map_filter(known, lambda k, _: k != "score"), score).alias("metadata"))


def of_test(spark: SparkSession, uri: str | None = None, json_text: str | None = None) -> list:
    """Examples for a parametrised test: of the JSON text if given, else of the dataset that the URI names."""
    if not (json_text and json_text.strip()) and not (uri and uri.strip()):
        raise ValueError("a test's dataset needs a URI or JSON text")
    return list(from_json_text(spark, json_text) if json_text and json_text.strip() else Registry().resolve(spark, uri))


class Registry:
    """Resolvers of dataset URIs: those registered last come first, then package resources, then files."""

    def __init__(self) -> None:
        self.resolvers: list[tuple[Callable[[str], bool], Callable[[SparkSession, str], Dataset]]] = [(lambda u: u.startswith("classpath:"), _resource), (lambda u: bool(u.strip()) and not u.startswith("classpath:"), _file)]

    def register(self, supports: Callable[[str], bool], resolve: Callable[[SparkSession, str], Dataset]) -> None:
        self.resolvers.insert(0, (supports, resolve))

    def resolve(self, spark: SparkSession, uri: str) -> Dataset:
        for supports, resolve in self.resolvers:
            if supports(uri):
                return resolve(spark, uri)
        raise DatasetResolutionError(f"no resolver for {uri!r}")


def _file(spark: SparkSession, uri: str) -> Dataset:
    path = uri.removeprefix("file:")
    try:
        return from_csv(spark, path) if path.endswith(".csv") else from_json(spark, path)
    except Exception as e:
        raise DatasetResolutionError(f"cannot read {uri}: {e}") from e


def _resource(spark: SparkSession, uri: str) -> Dataset:
    """``classpath:package/path``: a file inside an installed Python package."""
    from importlib import resources

    package, _, path = uri.removeprefix("classpath:").lstrip("/").partition("/")
    try:
        text = resources.files(package).joinpath(path).read_text(encoding="utf-8")
    except (ModuleNotFoundError, FileNotFoundError, ValueError) as e:
        raise DatasetResolutionError(f"no resource {uri}") from e
    return from_csv_text(spark, text, path.rsplit("/", 1)[-1].rsplit(".", 1)[0]) if path.endswith(".csv") else from_json_text(spark, text)
