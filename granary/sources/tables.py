"""Scans: the supplied tables, and files of the kinds that a document platform reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators.render import result_name

from .files import new_files, read_at, read_files, read_places, read_versions

# Fixed value: what stands for a document without readable text.
NO_TEXT = "未提取到可读文本，上传的 PDF 可能是扫描件或受保护文档。"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



#: Bytes for each core below which a table is dealt out over all of them.
SPREAD = 32 << 20


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A small table dealt out by ``key`` over all cores, for work that is heavy for each row: a file of one row group is one task
    otherwise. A table above ``SPREAD`` bytes a core has splits enough and is not shuffled; the rows are the same either way."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores, key) if size < SPREAD * cores else rows


def read_json_rows(spark: SparkSession, path: str, schema: str, malformed: str = "DROPMALFORMED", lines: bool = False) -> DataFrame:
    """Files of a JSON array or object each, or of one object a line, with a schema given; what does not parse is dropped."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", malformed).json(path)


def paper_metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Paper rows of JSON files (an array each, or one object a line), each with its template's tag first among its tags, newest first."""
    rows = read_json_rows(spark, path, "paper_id string, title string, template string, created_at string, domain_tags array<string>", lines=lines)
    tags = tx.distinct_in_order(F.concat(F.array(tx.domain_tag(F.col("template"))), F.coalesce("domain_tags", F.array().cast("array<string>"))))
    return rows.withColumn("domain_tags", tags).orderBy(F.desc("created_at"), "paper_id")


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the Markdown files of a folder, by name."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("content")).orderBy("name")


def read_template(spark: SparkSession, folder: str, name: str, default: str) -> DataFrame:
    """The named template or else the default one; a name with a path in it counts as unknown."""
    rows = templates(spark, folder)
    safe = name if "/" not in name and ".." not in name else default
    return rows.where(F.col("name").isin(safe, default)).orderBy((F.col("name") != safe).cast("int")).limit(1)


def results(spark: SparkSession, root: str, kinds: DataFrame) -> DataFrame:
    """``kinds`` (paper_id, kind, template) with the newest content of each result file, an empty text where there is none."""
    parts = F.split("path", "/")
    found = read_places(spark, root, ".md").where(F.size(parts) > 1).groupBy(F.element_at(parts, -2).alias("_paper"), F.element_at(parts, -1).alias("_name")).agg(F.max(F.struct("written", "at", "n")).alias("_v"))
    own = kinds.withColumn("_paper", F.col("paper_id").cast("string")).withColumn("_name", result_name(F.col("kind"), F.col("template")))
    # Spark takes what comes from few slices for small; it is the names of all files, which no driver is to broadcast.
    places = own.join(found.hint("merge"), ["_paper", "_name"], "left").select(*kinds.columns, F.col("_v.at").alias("at"), F.col("_v.n").alias("n"))
    return read_at(places, root).select(*kinds.columns, F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))


def states(spark: SparkSession, folder: str) -> DataFrame:
    """(id, paper_id, status, payload, broken) of a folder of JSON files, one a state: a file that is no such object is a broken row
    and not dropped unseen; missing fields have defaults."""
    fields = "array<struct<request_id:string,paper_id:string,status:string,payload:string>>"
    parsed = read_files(spark, folder).select(F.explode_outer(F.from_json(F.col("content").cast("string"), fields)).alias("s")).select("s.*")
    broken = F.col("request_id").isNull()
    return parsed.select(F.col("request_id").alias("id"), "paper_id", F.when(~broken, F.coalesce("status", F.lit("pending"))).alias("status"), F.coalesce("payload", F.lit("{}")).alias("payload"), broken.alias("broken"))


def tool_folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder, tool, description, prompt, problem) of each folder that has a prompt or a schema: a tool needs both, and a schema
    that names it in one of three layouts. Of a folder that is none, ``problem`` says why."""
    parts = F.split("path", "/")
    named = read_versions(spark, root, "prompt.md", "schema.json").where(F.size(parts) > 1).select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "written", F.col("content").cast("string").alias("value"))
    newest = lambda name: F.max_by("value", F.when(F.col("name") == name, F.col("written")))
    per = named.where(F.col("name").isin("prompt.md", "schema.json")).groupBy("folder").agg(newest("prompt.md").alias("prompt"), newest("schema.json").alias("schema"))
    own = lambda key: F.coalesce(*(F.nullif(F.get_json_object("schema", f"$.{at}{key}"), F.lit("")) for at in ("function.", "tool.function.", "")))
    problem = (
        F.when(F.col("prompt").isNull(), "no prompt").when(F.col("schema").isNull(), "no schema").when(F.try_parse_json("schema").isNull(), "schema is no JSON").when(own("name").isNull(), "schema names no tool")
    )
    some = per.where("prompt IS NOT NULL OR schema IS NOT NULL")
    return some.select("folder", F.when(problem.isNull(), own("name")).alias("tool"), F.when(problem.isNull(), F.coalesce(own("description"), F.lit(""))).alias("description"), "prompt", problem.alias("problem"))


def pdf_pages(pages: DataFrame) -> DataFrame:
    """(paper_id, text) from (paper_id, pages: array of page texts): empty pages go, each page gets its mark, none gives a fixed sentence.

    Text extraction itself is a pluggable function that fills ``pages``; no PDF library is needed here.
    """
    numbered = F.transform("pages", lambda p, i: F.struct((i + 1).alias("n"), tx.strip(p).alias("t")))
    full = F.filter(numbered, lambda x: x["t"] != "")
    return pages.select("paper_id", F.when(F.size(full) > 0, F.array_join(F.transform(full, lambda x: F.concat(F.lit("[Page "), x["n"], F.lit("]\n"), x["t"])), "\n\n")).otherwise(F.lit(NO_TEXT)).alias("text"))


def pdf_title(title: Column, file_name: Column) -> Column:
    """The metadata title if it says something, else the stem of the file's name."""
    stem = F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", "")
    return F.when((F.length(F.trim(title)) > 2) & ~F.contains(F.lower(title), F.lit("untitled")), F.trim(title)).otherwise(stem)


def atom_entries(feeds: DataFrame, xml: str = "xml", keys: list[str] | None = None) -> DataFrame:
    """(title, published, url, summary) of the entries of Atom feeds; entries without a title go, summaries are cut at 320."""
    schema = "struct<entry:array<struct<title:string,published:string,id:string,summary:string>>>"
    parsed = feeds.select(*keys or [], F.from_xml(F.col(xml), schema).alias("f"))
    e = parsed.select(*keys or [], F.explode("f.entry").alias("e"))
    rows = e.select(*keys or [], tx.collapse(F.col("e.title")).alias("title"), F.col("e.published").alias("published"), F.trim("e.id").alias("url"), F.substring(tx.collapse(F.col("e.summary")), 1, 320).alias("summary"))
    return rows.where("title IS NOT NULL AND title <> ''")


def web_results(payloads: DataFrame, column: str = "payload", most: int = 3, keys: list[str] | None = None) -> DataFrame:
    """(title, url, content, score) of a search service's JSON answer; the number is held between 1 and 5."""
    n = max(1, min(most, 5))
    schema = "struct<results:array<struct<title:string,url:string,content:string,score:double>>>"
    one = payloads.select(*keys or [], F.posexplode(F.slice(F.from_json(F.col(column), schema)["results"], 1, n)).alias("pos", "r"))
    return one.select(*keys or [], "pos", F.col("r.title").alias("title"), F.col("r.url").alias("url"), F.substring("r.content", 1, 500).alias("content"), F.col("r.score").alias("score"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, content) of new PDF files of a tree; other files are not seen."""
    return new_files(spark, folder, ".pdf")


def token_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a Markdown pipe table of token use: header and rule rows, short rows and rows with bad numbers go."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(column), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.col(column).startswith("|")).select(cells.alias("c")).where("size(c) >= 6")
    n = lambda i: F.expr(f"try_cast(c[{i}] AS bigint)")
    return rows.select(F.expr("c[0]").alias("at"), F.expr("c[1]").alias("project"), F.expr("c[2]").alias("model"), n(3).alias("prompt"), n(4).alias("completion"), n(5).alias("total")).where("prompt IS NOT NULL AND completion IS NOT NULL AND total IS NOT NULL")
