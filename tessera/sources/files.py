"""Source-tree scans: listing, languages, ignore rules, owners, manifests, reports and logs as relations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed table: file ending to language.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c",
    "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "md": "markdown", "json": "json", "yml": "yaml",
}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size and time of every file below root; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and text of the files below root whose names match a glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def language(path: Column, text: Column | None = None) -> Column:
    """Language by file ending, else by the first line."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_ending = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[ending]
    if text is None:
        return F.coalesce(by_ending, F.lit("unknown"))
    first = F.substring_index(text, "\n", 1)
    by_line = F.when(first.rlike(r"^#!.*python"), "python").when(first.rlike(r"^#!.*node"), "javascript").when(first.rlike(r"^#!.*\b(ba|z)?sh\b"), "shell")
    return F.coalesce(by_ending, by_line, F.lit("unknown"))


def glob_regex(glob: str) -> str:
    """A Java regex for a path glob with `*`, `**` and `?`; a trailing slash means everything below."""
    anchored = glob.startswith("/") or "/" in glob.rstrip("/")
    body = glob.strip("/") + ("/**" if glob.endswith("/") else "")
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = "".join(parts.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body))
    return ("^" if anchored else "(?:^|/)") + out + "(?:/.*)?$"


def not_ignored(files: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """Files that no ignore rule takes out; a rule with `!` takes back in, and the last rule that matches decides."""
    ignored: Column = F.lit(False)
    for g in globs:
        if g.strip() and not g.startswith("#"):
            ignored = F.when(F.col(path).rlike(glob_regex(g.lstrip("!"))), F.lit(not g.startswith("!"))).otherwise(ignored)
    return files.filter(~ignored)


def owners(files: DataFrame, rules: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """files with their owner: that of the last rule that matches."""
    owner = F.coalesce(*(F.when(F.col(path).rlike(glob_regex(g)), F.lit(o)) for g, o in reversed(rules)), F.lit(None).cast("string"))
    return files.withColumn("owner", owner)


def requirements(manifests: DataFrame) -> DataFrame:
    """path, name, version of each pinned or bounded line of requirements files."""
    rows = manifests.select("path", F.explode(F.split("text", r"\r?\n")).alias("line"))
    rows = rows.select("path", F.trim(F.regexp_replace("line", r"#.*$", "")).alias("line"))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:[=~<>!]=?=?\s*([0-9][A-Za-z0-9.*+-]*))?"
    parsed = rows.select("path", F.lower(F.regexp_extract("line", pattern, 1)).alias("name"), F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")).alias("version"))
    return parsed.filter("name <> ''")


def package_json(manifests: DataFrame) -> DataFrame:
    """path, name, version of dependencies in package.json files, range marks taken off."""
    parsed = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    deps = F.map_concat(F.coalesce(parsed["devDependencies"], F.expr("map()").cast("map<string,string>")), F.map_filter(F.coalesce(parsed["dependencies"], F.expr("map()").cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.coalesce(parsed["devDependencies"], F.expr("map()").cast("map<string,string>")), k)))
    rows = manifests.select("path", F.explode(deps).alias("name", "version"))
    return rows.withColumn("version", F.regexp_replace("version", r"^[\^~>=<\s]+", ""))


def sarif(reports: DataFrame) -> DataFrame:
    """tool, rule, level, file and line of each result of SARIF reports."""
    schema = "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
    runs = reports.select(F.explode(F.from_json("text", schema)["runs"]).alias("run"))
    results = runs.select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    return results.select("tool", F.col("r.ruleId").alias("rule"), F.coalesce("r.level", F.lit("warning")).alias("level"), place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"))


def audit_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of JSON-lines files; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def virtual_files(texts_: DataFrame) -> DataFrame:
    """path and text of the parts of a text that `// FILE: name` lines head."""
    part = F.explode(F.split("text", r"(?m)(?=^// FILE: )"))
    rows = texts_.select(part.alias("part")).filter(F.col("part").startswith("// FILE: "))
    return rows.select(F.trim(F.regexp_extract("part", r"^// FILE: ([^\n]*)", 1)).alias("path"), F.regexp_replace("part", r"^// FILE: [^\n]*\n?", "").alias("text"))
