"""Files to DataFrames and back: code trees, templates, QA records, stores, fine-tuning files, dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T


def code_files(spark: SparkSession, root: str, suffix: str = "py") -> DataFrame:
    """(file: path below the root, content, modified, size) of every file with the suffix."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(whole)), F.substring("path", len(whole) + 1, 1 << 30)).otherwise(F.col("path"))
    return rows.select(relative.alias("file"), "content", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def in_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """A repository given as path and text."""
    return spark.createDataFrame([(p, t.encode()) for p, t in sorted(files.items())], "file string, content binary")


def code_documents(spark: SparkSession, root: str, suffix: str = "py") -> DataFrame:
    """file_path, file_name, mime, category (test or implementation), text."""
    from ..operators import predicates

    rows = code_files(spark, root, suffix)
    category = F.when(predicates.is_test(F.col("file")), "test").otherwise("implementation")
    return rows.select(F.col("file").alias("file_path"), F.regexp_replace("file", "^.*/", "").alias("file_name"), T.media_type(F.col("file")).alias("mime"), category.alias("category"), F.col("content").cast("string").alias("text"))


def templates(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """(category: file stem, template, line) of non-blank lines of <root>/<Category>.txt."""
    rows = spark.read.text(f"{root}/*.txt", wholetext=True).select("value", F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("category"))
    rows = rows.where(F.col("category").isin(*names)) if names else rows
    lines = rows.select("category", F.posexplode(F.split("value", "\r?\n")).alias("line", "t"))
    return lines.select("category", F.trim("t").alias("template"), "line").where("template <> ''")


def nested_templates(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """The same from <root>/<category>/*.txt, without // comment lines."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("category"))
    rows = rows.where(F.lower("category").isin(*[n.lower() for n in names])) if names else rows
    lines = rows.select("category", F.posexplode(F.split("value", "\r?\n")).alias("line", "t"))
    return lines.select("category", F.trim("t").alias("template"), "line").where("template <> '' and not startswith(template, '//')")


def qa_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid records, invalid ones as text) of a JSON array file or JSON lines; invalid records don't stop the read."""
    schema = f"{schemas.QA_PAIR}, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ok = F.col("_corrupt").isNull() & F.col("question").isNotNull()
    return rows.where(ok).drop("_corrupt"), rows.where(~ok).select("_corrupt")


def in_batches(rows: DataFrame, function, schema: str, size: int = 100, keep_going: bool = False) -> DataFrame:
    """function(list of records) for batches of rows; the last may be smaller. A failing batch fails the read, or with
    keep_going is left out."""
    import pandas as pd

    names = [f.name for f in spark_schema(rows.sparkSession, schema).fields]

    def run(frames):
        for frame in frames:
            records = frame.to_dict("records")
            for at in range(0, len(records), size):
                try:
                    yield pd.DataFrame(list(function(records[at : at + size])), columns=names)
                except Exception:
                    if not keep_going:
                        raise

    return rows.mapInPandas(run, schema)


def spark_schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def write_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines."""
    rows.write.mode(mode).json(path)


def save_store(vectors: DataFrame, path: str, **tables: DataFrame) -> None:
    """A vector store as Parquet: vectors, and further tables (chunks, names, settings) beside them."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_store(spark: SparkSession, path: str, *tables: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("vectors", *tables)}


def resolved_store(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored vectors, built and saved first where there are none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/vectors")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        save_store(build(), path)
    return spark.read.parquet(f"{path}/vectors")


def trajectories(spark: SparkSession, root: str) -> DataFrame:
    """Search-tree nodes of non-empty trajectory.json files below the root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "trajectory.json").load(root)
    return found.where("length > 0").select("path", F.from_json(F.col("content").cast("string"), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in schemas.NODES.split(', '))}>>").alias("n")).select("path", F.inline("n"))


def instances(spark: SparkSession, path: str, sort_by: str = "instance_id") -> DataFrame:
    return spark.read.parquet(path).orderBy(sort_by)


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """path, mime, base64 content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select("path", T.media_type(F.col("path")).alias("mime"), F.base64("content").alias("content"))


def next_number(files: DataFrame, name: str = "file_name") -> DataFrame:
    """One row: files, and one more than the greatest number before the first dot of the JSON files; score.json isn't one."""
    counted = F.endswith(name, F.lit(".json")) & (F.col(name) != "score.json")
    stem = F.when(counted, F.substring_index(F.col(name), ".", 1).try_cast("int"))
    return files.agg(F.count("*").alias("files"), (F.greatest(F.coalesce(F.max(stem), F.lit(0)), F.lit(0)) + 1).alias("next"))


# The fine-tuning forms, and what they say about a repository (system message, description).
FORMS = ("claude", "openai", "llama", "general", "csv")
ABOUT = {
    "django": ("你是Django框架的专家，精通Web开发、ORM和MVC架构。请用中文回答关于Django源码的问题。", "Django是一个高级Python Web框架，鼓励快速开发和简洁实用的设计。"),
    "pytorch": ("你是PyTorch深度学习框架的专家，精通神经网络和机器学习算法。请用中文回答关于PyTorch源码的问题。", "PyTorch是一个开源的机器学习库，提供灵活的神经网络构建工具。"),
}
ANY = ("你是{}代码库的专家，精通相关技术和架构。请用中文回答问题。", "{}是一个代码仓库。")


def about(repo: str) -> tuple[str, str]:
    return ABOUT.get(repo) or tuple(t.format(repo) for t in ANY)


def training_value(form: str, repo: str) -> Column:
    """A pair's training record as JSON; unknown forms are general."""
    system, described = (F.lit(x) for x in about(repo))
    question, answer = F.col("question"), F.col("answer")
    if form in ("claude", "openai"):
        said = (("system", system), ("human" if form == "claude" else "user", question), ("assistant", answer))
        fields = {"messages": F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in said])}
    elif form == "llama":
        fields = {"system": system, "instruction": question, "output": answer}
    else:
        fields = {"system_instruction": system, "question": question, "answer": answer, "context": described}
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def training_lines(pairs: DataFrame, form: str = "general", repo: str = "repository") -> DataFrame:
    """`value`: a training record for each pair with a question and an answer. csv keeps columns (system, question, answer,
    context: empty) instead."""
    rows = pairs.where("question <> '' and answer <> ''")
    if form == "csv":
        return rows.select(F.lit(about(repo)[0]).alias("system"), "question", "answer", F.lit("").alias("context"))
    return rows.select(training_value(form, repo).alias("value"))


def write_training(pairs: DataFrame, path: str, form: str = "general", repo: str = "repository") -> None:
    rows = training_lines(pairs, form, repo)
    rows.write.mode("overwrite").csv(path, header=True) if form == "csv" else rows.write.mode("overwrite").text(path)


def instructions(lines: DataFrame, asker: str = "human") -> DataFrame:
    """(instruction, output) of message records: the first message of each role."""
    parsed = lines.select(F.from_json("value", "messages array<struct<role:string,content:string>>").alias("m"))
    first = lambda role: F.get(F.filter("m.messages", lambda m: m["role"] == role), F.lit(0))["content"]
    return parsed.select(F.coalesce(first(asker), F.lit("")).alias("instruction"), F.coalesce(first("assistant"), F.lit("")).alias("output"))


def clipped(code: Column, most: int = 500) -> Column:
    return F.when(F.length(code) > most, F.concat(F.substring(code, 1, most), F.lit("..."))).otherwise(code)


def code_dump(functions: DataFrame, most: int = 500) -> DataFrame:
    """Functions with clipped code, its length and the numbers of parameters and calls."""
    return functions.withColumns({"code_length": F.length("code"), "n_parameters": F.size("parameters"), "n_calls": F.size("calls"), "code": clipped(F.col("code"), most)})


def report_text(rows: DataFrame, score: str = "score") -> DataFrame:
    """One line of a text report."""
    from ..operators import aggregates

    return aggregates.report(rows, score).select(F.format_string("Total: %d\nAverage score: %.2f", "total", "average").alias("value"))
