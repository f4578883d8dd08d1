"""Content-addressed manifests of folders of files (``onefile.read_files``), and what changed in one.

A manifest lists the files that a build serves by path ("/" and the path below the folder) with the sha256 of their
bytes, and apart from them the files that only configure the server. Files are hashed where they are read; no content
travels.

Defined cases: an empty folder has an empty manifest; only files directly in the folder can be configuration or be left
out; a path that comes twice among files to write is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions import shapes
from assayline.functions.shapes import text_of
from assayline.operators import card
from assayline.session import shared_folder

# Files that configure the server, files that are not served, the version of a manifest.
CONFIGURATION = ("_headers", "_redirects")
NOT_SERVED = (".assetsignore", "build-manifest.json")
SCHEMA = 1
HASH, COMMIT = "^[0-9a-f]{64}\\z", "^[0-9a-f]{40}\\z"


def hashed(files: DataFrame) -> DataFrame:
    """``files`` (path, content and further columns) with hash and role (asset or config) for the content; files that are
    not served have no row."""
    name = F.when(F.instr(F.substring("path", F.lit(2), F.length("path")), "/") == 0, F.substring("path", F.lit(2), F.length("path")))
    role = F.when(name.isin(*CONFIGURATION), "config").when(name.isin(*NOT_SERVED), None).otherwise("asset")
    return files.withColumns({"hash": F.sha2("content", 256), "role": role}).where("role is not null").drop("content")


def _listed(entries: Column, role: str) -> Column:
    """The paths and hashes of a role as a JSON object, sorted by path; configuration goes by name."""
    kept = F.filter(entries, lambda e: e["role"] == role)
    key = (lambda e: e["path"]) if role == "asset" else (lambda e: F.substring(e["path"], F.lit(2), F.length(e["path"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda e: F.concat(card.json_string(key(e)), F.lit(':"'), e["hash"], F.lit('"'))), ","), F.lit("}"))


def manifests(entries: DataFrame, builds: DataFrame) -> DataFrame:
    """build and manifest for each of ``builds`` (build, repository, commit, env, run, dirty, worker_file, worker_hash) from
    ``entries`` (build, path, hash, role). A build without files has empty lists."""
    of_build = entries.groupBy("build").agg(F.array_sort(F.collect_list(F.struct("path", "hash", "role"))).alias("_e"))
    nothing = F.array().cast("array<struct<path:string,hash:string,role:string>>")
    joined = builds.join(of_build, "build", "left").withColumn("_e", F.coalesce("_e", nothing))
    text = lambda c: card.json_string(F.col(c))
    body = card.json_object(
        ("schema", F.lit(str(SCHEMA))), ("repository", text("repository")), ("commit", text("commit")), ("dirty", F.when(F.col("dirty"), F.lit("true"))), ("env", text("env")),
        ("run", F.when(F.col("run").isNull(), F.lit("null")).otherwise(text("run"))), ("worker", card.json_object(("file", text("worker_file")), ("sha256", text("worker_hash")))),
        ("assets", _listed(F.col("_e"), "asset")), ("config", _listed(F.col("_e"), "config")),
    )
    return joined.select("build", body.alias("manifest"))


def parse(texts: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(files, problems) of manifests: key, role, path, hash of the ones that are whole, and key and problem of the others,
    the first of a bad head, a bad asset (by path) or a bad configuration entry (by name)."""
    v = F.col("_v")
    hashes = lambda at: F.map_entries(F.try_variant_get(v, at, "map<string,variant>"))
    as_text = lambda es: F.transform(es, lambda e: F.struct(e["key"].alias("path"), text_of(e["value"], "$").alias("hash")))
    read = texts.select(key, F.try_parse_json(column).alias("_v")).select(
        key, shapes.exactly(SCHEMA)(v, "$.schema", shapes.Name()).isNull().alias("_schema"), text_of(v, "$.commit").alias("_commit"), text_of(v, "$.worker.sha256").alias("_worker"), as_text(hashes("$.assets")).alias("_a"), as_text(hashes("$.config")).alias("_c")
    )
    ok = lambda c, form: F.coalesce(c.rlike(form), F.lit(False))
    head = F.col("_schema") & ok(F.col("_commit"), COMMIT) & ok(F.col("_worker"), HASH) & F.col("_a").isNotNull() & F.col("_c").isNotNull()
    first = lambda c, good: F.get(F.array_sort(F.transform(F.filter(c, lambda e: ~good(e)), lambda e: e["path"])), F.lit(0))
    asset = first("_a", lambda e: e["path"].startswith("/") & ~e["path"].contains("..") & ok(e["hash"], HASH))
    config = first("_c", lambda e: e["path"].isin(*CONFIGURATION) & ok(e["hash"], HASH))
    problem = F.coalesce(
        F.when(~head, F.lit(f"not a build manifest (schema {SCHEMA})")), F.concat(F.lit("manifest has a bad asset entry: "), asset), F.concat(F.lit("manifest has a bad config entry: "), config)
    )
    # written, so that manifests are made and parsed once for both results
    spark, folder = texts.sparkSession, shared_folder(texts.sparkSession)
    read.select(key, "_a", "_c", problem.alias("problem")).write.parquet(folder)
    judged = spark.read.parquet(folder)
    tagged = lambda c, role: F.transform(c, lambda e: F.struct(F.lit(role).alias("role"), e["path"].alias("path"), e["hash"].alias("hash")))
    files = judged.where("problem is null").select(key, F.explode(F.concat(tagged("_a", "asset"), tagged("_c", "config"))).alias("f")).select(key, "f.role", "f.path", "f.hash")
    return files, judged.where("problem is not null").select(key, "problem")


def changed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of ``files`` (path, content) that ``stored`` (path, content) lacks or holds otherwise, by their hashes."""
    there = stored.select(F.col("path").alias("_path"), F.sha2("content", 256).alias("_hash"))
    return files.join(there, (F.col("path") == F.col("_path")) & (F.sha2("content", 256) == F.col("_hash")), "left_anti")
