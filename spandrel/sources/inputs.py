"""Sources and sinks: requests, sources, compiler output, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions.text import identity, valid_file_name, valid_source


def read_sources(spark: SparkSession, folder: str, pattern: str = "*.sol") -> DataFrame:
    """``(file, source, byte_length, sha256)`` of all source files below a folder, line ends made ``\\n``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n")
    rows = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), text.alias("source"))
    return rows.select("file", "source", identity(F.col("source")).alias("i")).select("file", "source", "i.*")


def read_compiled(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, output)``: compiler output by the source file that it names first."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    return raw.select(F.expr("json_object_keys(get_json_object(value, '$.sources'))[0]").alias("file"), F.col("value").alias("output"))


def tolerant_object(text: str) -> Column:
    """The JSON object in column ``text``, before which other output may come; null if there is none."""
    parsed = F.expr(f"try_parse_json(substring({text}, instr({text}, '{{')))")
    return F.when((F.instr(text, "{") > 0) & F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Analysis requests ``(file, source, output, finding_id, rule_id)`` from JSON lines, and those that are not valid."""
    schema = "fileName string, source string, compilerOutput string, findingId string, ruleId string"
    rows = spark.read.schema(schema).json(path).select(F.col("fileName").alias("file"), "source", F.col("compilerOutput").alias("output"), F.col("findingId").alias("finding_id"), F.col("ruleId").alias("rule_id"))
    good = valid_file_name(F.col("file")) & valid_source(F.col("source")) & F.col("output").isNotNull()
    return rows.filter(good), rows.filter(~good)


def request_object(spark: SparkSession, path: str) -> DataFrame:
    """One request per file, as an object that other output may precede: ``(file, source, output, error)``; all of its three keys are required."""
    raw = spark.read.text(path, wholetext=True)
    get = lambda key, kind: F.expr(f"try_variant_get(request, '$.{key}', '{kind}')")
    rows = raw.select(tolerant_object("value").alias("request"))
    rows = rows.select("request", get("fileName", "string").alias("file"), get("source", "string").alias("source"), F.coalesce(get("compilerOutput", "string"), F.to_json(get("compilerOutput", "variant"))).alias("output"))
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(k)) for c, k in (("file", "fileName"), ("source", "source"), ("output", "compilerOutput")))), lambda k: k.isNotNull()), ", ")
    return rows.select("file", "source", "output", F.when(F.col("request").isNull(), "no JSON object").when(missing != "", F.concat(F.lit("missing: "), missing)).alias("error"))


def named_samples(names: DataFrame, samples: DataFrame) -> DataFrame:
    """``(name, source, found)`` for each asked ``name``: only those of ``samples(name, source)`` can be read; others are answered as not found."""
    return names.select("name").join(F.broadcast(samples.select("name", "source")), "name", "left").withColumn("found", F.col("source").isNotNull())


def compile_rows(sources: DataFrame, provider, most_seconds: float | None = None) -> DataFrame:
    """``(file, source, output, status, error, sha256)`` by an injected compiler ``provider(source, file) -> JSON text``, run where the rows are.

    ``status``: ``compiled``; ``diagnostics`` if the output reports errors; ``timeout`` after ``most_seconds``; ``failed`` if the provider
    raises or gives no JSON.  A row that fails does not fail the job, and what meets the limit is ended with its process.
    """
    import json
    from hashlib import sha256

    import pyarrow as pa

    def limited(source: str, file: str) -> str | None:
        """The provider's output from a process of its own, which ends at the limit; None if it is met."""
        import multiprocessing

        context = multiprocessing.get_context("fork")
        mine, its = context.Pipe(False)

        def work() -> None:
            try:
                its.send((True, provider(source, file)))
            except BaseException as e:  # noqa: BLE001 - told to the parent
                its.send((False, f"{type(e).__name__}: {e}"))

        process = context.Process(target=work, daemon=True)
        process.start()
        its.close()
        try:
            if not mine.poll(most_seconds):
                return None
            good, value = mine.recv()
        except EOFError:
            good, value = False, "the provider's process died"
        finally:
            process.kill()
            process.join()
            mine.close()
        if not good:
            raise RuntimeError(value)
        return value

    def one(source: str, file: str) -> tuple:
        try:
            output = provider(source, file) if most_seconds is None else limited(source, file)
            if output is None and most_seconds is not None:
                return None, "timeout", f"no result after {most_seconds} s"
            errors = [e.get("message", "") for e in json.loads(output).get("errors") or [] if e.get("severity") == "error"]
            return (output, "diagnostics", "; ".join(errors)) if errors else (output, "compiled", None)
        except Exception as e:  # noqa: BLE001 - whatever a provider raises is this row's result
            return None, "failed", f"{type(e).__name__}: {e}"[:500]

    def run(batches):
        for batch in batches:
            files, texts = batch.column("file").to_pylist(), batch.column("source").to_pylist()
            done = [one(t, f) for f, t in zip(files, texts, strict=True)]
            digests = [None if t is None else sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("source"), *(pa.array([d[k] for d in done], pa.string()) for k in range(3)), pa.array(digests, pa.string())], ["file", "source", "output", "status", "error", "sha256"])

    return sources.select("file", "source").mapInArrow(run, "file string, source string, output string, status string, error string, sha256 string")


def compile_sources(sources: DataFrame, provider, most_seconds: float | None = None) -> DataFrame:
    """``(file, source, output)``; output is null where ``compile_rows`` has none."""
    return compile_rows(sources, provider, most_seconds).select("file", "source", "output")


def sorted_keys(value: Column, kind: DataType) -> Column:
    """``value`` with the fields of all structs in it in alphabetical order."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(sorted_keys(value.getField(f.name), f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(value, lambda _, x: sorted_keys(x, kind.valueType)))))
    return value


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in alphabetical order at every level."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    df.select(*(sorted_keys(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)).write.mode("overwrite").json(path)


def markdown_rows(rows: DataFrame) -> DataFrame:
    """``(value)``: a line of a Markdown table for each row; bars and line ends in cells are escaped."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", "<br>")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, rows.columns)), F.lit(" |")).alias("value"))


def write_markdown(rows: DataFrame, path: str) -> None:
    """The table of all ``rows`` as text files below ``path``, its head in a file that comes first."""
    spark = rows.sparkSession
    head = ["| " + " | ".join(x) + " |" for x in (rows.columns, ["---"] * len(rows.columns))]
    spark.createDataFrame([(line, i) for i, line in enumerate(head)], "value string, i int").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{path}/0-head")
    markdown_rows(rows).write.mode("overwrite").text(f"{path}/1-rows")


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A report table to look at, of at most ``most`` rows; ``write_markdown`` writes all."""
    head = ["| " + " | ".join(x) + " |" for x in (rows.columns, ["---"] * len(rows.columns))]
    return "\n".join([*head, *(r["value"] for r in markdown_rows(rows.limit(most)).collect())])
